"""Plans: end-to-end transforms (Bronze -> Silver -> Gold) and the query catalog."""
