"""The operators bound to the driver's tables: ``opN_<name>`` queries over whole tables, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voltaic.llm import (bpe, collocations, filter_audit, licenses, line_runs, prefix_hash, quality, simhash, token_files, toxicity,
                         url_templates, warc, winnow)
from voltaic.llm.common import LOWER, UPPER, WORD_PATTERN, stored, table
from voltaic.session import scratch_path


def id_remainder(n: int) -> Column:
    """crc32 of the id as text, modulo n; a NULL id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % n


def vocabulary_json(path: str | None = None) -> str:
    """Text of the tokenizer file; it goes to the tasks with the job, so only the driver needs the path."""
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def rank_model(path: str | None = None, pattern: str | None = None) -> str:
    import public_tokenizers
    return bpe.tokenizer_json(bpe.read_ranks(path or public_tokenizers.path("byte_bpe_50k.tiktoken")),
                              pattern or public_tokenizers.PATTERN)


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch_path(spark, "token-files")
    token_files.write_token_files(table(spark, sf_dir, "documents"), out, vocabulary_json(), end_id=2)
    return token_files.read_token_files(spark, out)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch_path(spark, "warc")
    files = warc.write_warc(table(spark, sf_dir, "pages"), out, min_bytes=0)
    return warc.read_warc(spark, out, files).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def bpe_digests(docs: DataFrame, model: str, keep_ids: bool = False) -> DataFrame:
    coded = bpe.round_trip(docs, model, text=False)
    return coded.select("doc_id", *["ids"] * keep_ids, "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"), "split_chars")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"), rank_model())


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (simhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, radius=4)
            .select("doc_id", "fingerprint", "component_id"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    labels = F.transform("places", lambda p: p["label"])
    starts, ends = F.transform("places", lambda p: p["start"]), F.transform("places", lambda p: p["end"])
    text = lambda arr: F.array_join(F.array_sort(F.array_distinct(arr)), ",")
    return found.select("doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
                        F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
                        text(labels).alias("base_labels"), text(F.concat(labels, "matched")).alias("labels"),
                        F.when(F.size("places") > 0, 1.0).otherwise(F.col("containment")).alias("score"), ends.alias("e")).drop("e")


def quality_model(described: DataFrame, labels: DataFrame) -> quality.Model:
    learn = id_remainder(5) != 0
    return quality.train(described, labels.where(learn & (F.col("quality") == 1)).select("doc_id"), learn)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    described = stored(quality.features(table(spark, sf_dir, "documents")), "quality-features")
    scored = quality.score(described, quality_model(described, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (id_remainder(5) == 0).alias("held_out"), "score",
                         (F.col("score") >= 0.3).cast("int").alias("predicted"))


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.Model:
    return toxicity.train(docs, labels, id_remainder(4) != 2)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity_model(docs, table(spark, sf_dir, "labels")))
    return scored.select("row.doc_id", "score", F.size("passages").cast("long").alias("n_passages")).select(
        "doc_id", (id_remainder(4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"),
        "n_passages")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = winnow.shared_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), span=10)
    items = F.array_distinct(F.transform("hits", lambda h: h["item_id"]))
    hit = winnow.covered(F.flatten(F.transform("hits", lambda h: h["spans"]))).cast("long")
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
                        F.sha2(F.array_join(F.array_sort(items), ",").cast("binary"), 256).alias("items_sha256"),
                        (F.size("hits") > 0).alias("contaminated"))


def op9_prefix_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_hash.compare_with_edits(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_runs.drop_common_lines(table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = collocations.collocations(table(spark, sf_dir, "documents"), max_words=3, min_count=10, subsume_percent=50, top=2000)
    return found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


# FIXED VALUES: rules of the contract
URL_RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    # rules label whole branches, not a random part of each: a template needs labels on half of its pages
    judged = url_templates.decide(table(spark, sf_dir, "pages"), URL_RULES, carry=["page_id"], min_labelled=0.5)
    return judged.select("row.page_id", "host", "path", "rule", "verdict")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_token_files, op2_warc, op3_byte_bpe, op4_simhash, op5_licenses, op6_quality, op7_toxicity,
                                   op8_decontaminate, op9_prefix_fingerprints, op10_line_dedup, op11_collocations, op12_url_filters,
                                   op13_filter_audit)}

# --- DuckDB SQL ---------------------------------------------------------------------------------------------------

_LOWER = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
_WORDS = f"regexp_extract_all({_LOWER}, '{WORD_PATTERN}')"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _op2_sql() -> str:
    return """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS hex FROM p),
b AS (SELECT *, list_aggregate(list_transform(range(1, 41),
        lambda i: lpad(bin(strpos('0123456789abcdef', hex[i:i]) - 1), 4, '0')), 'string_agg', '') AS bits FROM h),
d AS (SELECT *, list_aggregate(list_transform(range(0, 32),
        lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[(1 + list_sum(list_transform(range(1, 6),
             lambda j: bits[(5 * i + j):(5 * i + j)]::INT * (1 << (5 - j)))))::INT]), 'string_agg', '') AS payload_digest FROM b),
k AS (SELECT *, max(page_id) OVER (PARTITION BY hex) AS kept FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN kept IS NULL OR page_id IS NOT DISTINCT FROM kept THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM kept THEN kept END AS refers_to
FROM k"""


def _op5_sql() -> str:
    phrases = ", ".join(f"({_quoted(p)}, {_quoted(label)})" for p, label in licenses.PHRASES)
    templates = ", ".join(f"({_quoted(label)}, {', '.join(map(str, licenses.reach(t)))}, [{', '.join(map(_quoted, licenses.template_words(t)))}])"
                          for label, t in licenses.TEMPLATES)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
phrase(p, label) AS (VALUES {phrases}),
template(label, across, within, words) AS (VALUES {templates}),
base AS (SELECT r, label, unnest(list_filter(range(0, greatest(0, len(w) - len(string_split(p, ' ')) + 1)),
           lambda i: w[(i + 1):(i + len(string_split(p, ' ')))] = string_split(p, ' '))) AS start
         FROM (SELECT * FROM d, phrase WHERE contains(array_to_string(w, ' '), p))),
b AS (SELECT r, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word, list(DISTINCT label) AS labels
      FROM base GROUP BY r),
able AS (SELECT r, w, label, across, within, words, ceil(0.9 * len(words) - 1e-9) AS need FROM d, template
         WHERE len(list_intersect(words, list_distinct(w))) >= ceil(0.9 * len(words) - 1e-9)),
line AS (SELECT r, k, len(regexp_extract_all(translate(lines[k], '{UPPER}', '{LOWER}'), '{WORD_PATTERN}')) AS n
         FROM (SELECT r, lines, unnest(range(1, len(lines) + 1)) AS k FROM (SELECT r, string_split(text, chr(10)) AS lines FROM d))),
place AS (SELECT r, e, unnest(range(e - n + 1, e + 1)) AS i FROM (SELECT *, sum(n) OVER (PARTITION BY r ORDER BY k)::BIGINT AS e FROM line)),
block AS (SELECT r, label, need, words, w[i:(i + greatest(across, least(within, e - i + 1)) - 1)] AS b
          FROM able JOIN place USING (r) WHERE list_contains(words, w[i])),
hit AS (SELECT r, label, len(list_intersect(words, b)) / len(words) AS share FROM block WHERE len(list_intersect(words, b)) >= need),
m AS (SELECT r, list(DISTINCT label) AS labels, max(share) AS share FROM hit GROUP BY r)
SELECT doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word,
       last_word::BIGINT AS last_word, coalesce(array_to_string(list_sort(b.labels), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(m.labels, [])))), ','), '')
         AS labels,
       CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(share, 0.0) END::DOUBLE AS score
FROM d LEFT JOIN b USING (r) LEFT JOIN m USING (r)"""


def _op8_sql() -> str:
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT row_number() OVER () AS q, coalesce(item_id::VARCHAR, '') AS item_id, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, w[k:(k + least(10, len(w)) - 1)] AS x
        FROM (SELECT *, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS k FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
dw AS (SELECT r, n, k, w[k:(k + n - 1)] AS x
       FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT r, k, dw.n, item_id FROM dw JOIN win ON dw.n = win.n AND dw.x = win.x),
pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS p FROM hit) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
        FROM (SELECT DISTINCT r, item_id FROM hit) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (r) LEFT JOIN its USING (r)"""


def _op10_sql() -> str:
    blanks = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
line AS (SELECT r, doc_id, k, lines[k] AS line, trim(translate(lines[k], '{UPPER}', '{LOWER}'), {blanks}) AS key
         FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS k FROM d)),
common AS (SELECT key FROM line WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(common.key)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (WHERE common.key IS NULL), '')) AS kept_sha256
FROM line LEFT JOIN common ON line.key = common.key GROUP BY r, doc_id"""


def _op11_sql() -> str:
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, 'und') AS lang, {_LOWER} AS t FROM documents),
p AS (SELECT r, lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:(i + m - 1)], ' '))) AS phrase
      FROM (SELECT *, unnest([1, 2, 3]) AS m FROM w) WHERE len(w) >= m),
f AS (SELECT lang, m, phrase, count(*)::HUGEINT AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m >= 2 AND f >= 10),
cut AS (SELECT *, array_to_string(w[1:k], ' ') AS first, array_to_string(w[(k + 1):], ' ') AS rest
        FROM (SELECT *, unnest(range(1, m)) AS k FROM c)),
s AS (SELECT cut.lang, cut.m, cut.phrase, a, k, x.f AS l, y.f AS r, 1000000::HUGEINT * a * a // (x.f * y.f) AS score
      FROM cut JOIN f AS x ON x.lang = cut.lang AND x.phrase = first JOIN f AS y ON y.lang = cut.lang AND y.phrase = rest),
low AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
lo AS (SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase, a FROM c WHERE m = 3),
longer AS (SELECT lang, phrase, max(a) AS a FROM lo GROUP BY ALL),
kept AS (SELECT low.* FROM low LEFT JOIN longer USING (lang, phrase)
         WHERE low.m = 3 OR longer.a IS NULL OR 100 * longer.a < 50 * low.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM ranked JOIN n USING (lang) WHERE rank <= 2000"""


def _op13_sql() -> str:
    return f"""
WITH lab AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT documents.doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
      FROM documents LEFT JOIN lab ON documents.doc_id = lab.doc_id),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
x AS (SELECT part, good, toxic, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w),
             100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t), regexp_matches(t, '[#$%&*|]'),
             coalesce(doc_id > first, false)] AS fails FROM w),
m AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM x GROUP BY ALL),
l AS (SELECT unnest(string_split('ABCDE', '')) AS f),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM l a, l b, l c, l d, l e
      WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
step AS (SELECT filter_order, step, filter_order[step] AS f, strpos('ABCDE', filter_order[step]) AS bit,
                list_transform(range(1, step), lambda j: strpos('ABCDE', filter_order[j])) AS before FROM o, range(1, 6) AS k(step)),
e AS (SELECT part, filter_order, step, f, n, good, toxic, fails[bit] AS fail,
             len(list_filter(before, lambda b: fails[b])) > 0 AS gone, len(list_filter(fails, lambda y: y)) AS n_fails
      FROM m, step),
r AS (SELECT part, filter_order, step, f, coalesce(sum(n) FILTER (WHERE NOT gone AND NOT fail), 0) AS kept,
             coalesce(sum(n) FILTER (WHERE NOT gone AND fail), 0) AS removed, coalesce(sum(n) FILTER (WHERE gone AND fail), 0) AS redundant,
             coalesce(sum(n) FILTER (WHERE fail AND n_fails = 1), 0) AS unique_fails,
             coalesce(sum(good) FILTER (WHERE NOT gone AND fail), 0) AS good_lost,
             coalesce(sum(toxic) FILTER (WHERE NOT gone AND fail), 0) AS toxic_lost FROM e GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM r"""


ORACLE_SQL = {"op11_collocations": _op11_sql(), "op13_filter_audit": _op13_sql(), "op2_warc": _op2_sql(), "op5_licenses": _op5_sql(), "op8_decontaminate": _op8_sql(), "op10_line_dedup": _op10_sql()}
