"""DataFrame -> DataFrame operators. Every operator is lazy: no action inside."""
