"""Operator 12: URL filter by path-template trees.

Per host, paths make a tree of segments. ``templates`` turns it into templates,
level by level from the host down:

* a segment that holds enough pages of its node (``min_pages`` and ``min_share``)
  is a branch of its own; all others are variable and become the wildcard ``*``;
* branches of one node whose statistics cannot be told apart (Hoeffding bound
  on the shares of bad and good labels, of paths that end here and of paths
  that go on with a number) are merged: ``{a|b}``, or ``*`` with the wildcard.
  A branch joins the largest earlier one that it resembles;
* a path's template is the way it takes. Its *purity* is the share of bad pages
  among its labelled ones, smoothed by ``weight`` pages of the host's share,
  which in turn is smoothed by the corpus' share. Templates with a bad label
  of their own, a purity of at least ``reject`` and labels on at least
  ``min_labelled`` of their pages are rejected.

``decide`` puts listed rules first: the longest rule whose host (or a domain
below it) and path prefix fit wins; all other urls get their template's verdict.

Every level is an aggregate over (host, node, segment), a ranking cut to
1 / min_share segments per node before the shuffle, and a join back of what the
nodes decided. Nodes with a thousandth of all pages or more, at most a thousand
of them, are broadcast; the pages of all other nodes, none larger than that,
are joined by shuffle: a host with a third of all pages never meets in one
task. Rows are written once per level to the shared folder.

Edge cases: NULL urls and urls without ``://`` have an empty host and path and
the template of no segments; empty segments (``//``, a slash at the end) are
segments; paths deeper than ``max_depth`` keep their rest as one last segment,
so no character is left out; segments that hold ``*``, ``{``, ``}`` or ``|`` are
variable; repeated rows count each; ties in size go by the segment; NULL labels
are no labels; an empty table gives an empty result; carried columns come back
in a struct, so their names can clash with nothing.
"""

from __future__ import annotations

from math import log, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voltaic.llm.common import LOWER, UPPER, carried, spread_join, stored

FEATURES = ("bad", "good", "ends", "numbers")
NODE = ["host", "node"]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; empty where there is no ``://``."""
    whole = F.coalesce(url, F.lit(""))
    at = F.locate("://", whole)
    rest = F.when(at > 0, F.substring(whole, at + 3, F.length(whole))).otherwise("")
    head = F.regexp_extract(rest, r"(?s)^([^?#]*)", 1)
    slash = F.locate("/", head)
    host = F.when(slash > 0, F.substring(head, F.lit(1), slash - 1)).otherwise(head)
    path = F.when(slash > 0, F.substring(head, slash, F.length(head))).otherwise("")
    return F.translate(host, UPPER, LOWER), path


def longest_rule(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule ``host/path`` that fits, or NULL; of equally long ones the first in order."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (-len(r), r), reverse=True):
        own, slash, rest = rule.partition("/")
        fits = ((host == own) | F.endswith(host, F.lit("." + own))) & F.startswith(path, F.lit(slash + rest))
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def segments(path: Column, max_depth: int) -> Column:
    """Segments of a path; those from the ``max_depth``-th on as one."""
    every = F.split(F.substring(path, F.lit(2), F.length(path)), "/", -1)
    rest = F.array_join(F.slice(every, max_depth, F.greatest(F.size(every), F.lit(1))), "/")
    cut = F.when(F.size(every) > max_depth, F.concat(F.slice(every, 1, max_depth - 1), F.array(rest))).otherwise(every)
    return F.when(F.length(path) > 0, cut).otherwise(F.array().cast("array<string>"))


def similar(a: dict, b: dict, alpha: float) -> bool:
    """True if no feature's shares differ by more than chance allows (Hoeffding bound)."""
    bound = sqrt(log(2 / alpha) / 2) * (1 / sqrt(a["n"]) + 1 / sqrt(b["n"]))
    return all(abs(a[f] / a["n"] - b[f] / b["n"]) < bound for f in FEATURES)


def merged_branches(branches: list[dict], alpha: float) -> dict[str, str]:
    """Segment -> name of its merged branch (the wildcard's segment is ``*``; what joins it is not listed)."""
    groups: list[dict] = []
    for b in sorted(branches, key=lambda b: (-b["n"], b["seg"])):
        home = next((g for g in groups if similar(g, b, alpha)), None)
        if home is None:
            groups.append({**b, "segs": [b["seg"]]})
        else:
            home["segs"].append(b["seg"])
            for k in ("n", *FEATURES):
                home[k] += b[k]
    named = {}
    for g in groups:
        if "*" not in g["segs"]:
            name = g["segs"][0] if len(g["segs"]) == 1 else "{" + "|".join(sorted(g["segs"])) + "}"
            named |= dict.fromkeys(g["segs"], name)
    return named


def _merge(alpha: float):
    def run(batches):
        import pyarrow as pa
        schema = pa.schema([("host", pa.string()), ("node", pa.string()), ("n", pa.int64()),
                            ("names", pa.map_(pa.string(), pa.string()))])
        for batch in batches:
            out = [{"host": r["host"], "node": r["node"], "n": r["n"],
                    "names": list(merged_branches(r["branches"], alpha).items())} for r in batch.to_pylist()]
            yield pa.RecordBatch.from_pylist(out, schema)
    return run


def _decisions(active: DataFrame, depth: int, min_pages: int, min_share: float, alpha: float) -> DataFrame:
    """host, node, n, names (segment -> branch) of every node of a level; segments without a name are variable."""
    seg, after = F.get("segs", F.lit(depth)), F.get("segs", F.lit(depth + 1))
    rows = active.select(*NODE, seg.alias("seg"), (F.col("label") == 1).alias("bad"), (F.col("label") == 0).alias("good"),
                         after.isNull().alias("ends"), F.rlike(after, F.lit("^[0-9]")).alias("numbers"))
    count = [F.sum(F.coalesce(F.col(f).cast("long"), F.lit(0))).alias(f) for f in FEATURES]
    children = rows.groupBy(*NODE, "seg").agg(F.count(F.lit(1)).alias("n"), *count)
    counts = ["n", *FEATURES]
    totals = children.groupBy(*NODE).agg(*[F.sum(c).alias(c) for c in counts])
    # a segment with min_share of its node's pages is among the first 1 / min_share
    large = children.where((F.col("n") >= min_pages) & ~F.rlike("seg", F.lit(r"[*{}|]")))
    rank = F.row_number().over(Window.partitionBy(*NODE).orderBy(F.desc("n"), F.asc("seg")))
    large = large.withColumn("rank", rank).where(F.col("rank") <= int(1 / min_share))
    own = F.struct("seg", *counts)
    large = large.groupBy(*NODE).agg(F.collect_list(own).alias("large"))  # at most 1 / min_share
    both = totals.join(large, NODE, "left").withColumn("kept", F.filter(
        F.coalesce("large", F.array().cast(dict(large.dtypes)["large"])), lambda b: b["n"] >= F.col("n") * min_share))
    rest = [(F.col(c) - F.aggregate(F.transform("kept", lambda b: b[c]), F.lit(0).cast("long"), lambda a, x: a + x)).alias(c)  # noqa: B023
            for c in counts]
    wildcard = F.struct(F.lit("*").alias("seg"), *rest)
    branches = F.concat("kept", F.filter(F.array(wildcard), lambda b: b["n"] > 0))
    return both.select(*NODE, "n", branches.alias("branches")).mapInArrow(
        _merge(alpha), "host string, node string, n long, names map<string,string>")


def templates(urls: DataFrame, url_col: str = "url", label: Column | None = None, min_pages: int = 5, min_share: float = 0.02,
              alpha: float = 0.05, max_depth: int = 8, carry: list[str] | None = None) -> DataFrame:
    """host, path, label (1 bad, 0 good, NULL unknown), node (the template's path) of every url; with ``carry`` also
    those columns of its row, as a struct ``row``. ``label`` is an expression over the columns host and path, or
    over ``row``."""
    host, path = host_and_path(F.col(url_col).cast("string"))
    rows = urls.select(*carried(carry), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("label", (F.lit(None) if label is None else label).cast("int"))
    rows = stored(rows.withColumns({"segs": segments(F.col("path"), max_depth), "node": F.lit("")}), "url-rows")
    seen = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("segs")).alias("depth")).first()
    for depth in range(seen["depth"] or 0):
        active = F.size("segs") > depth
        decided = stored(_decisions(rows.where(active), depth, min_pages, min_share, alpha), "url-nodes")
        named = F.coalesce(F.element_at("names", F.get("segs", F.lit(depth))), F.lit("*"))
        grown = spread_join(rows.where(active), decided, NODE, seen["n"]).withColumn("node", F.concat("node", F.lit("/"), named))
        rows = stored(grown.select(*rows.columns).unionByName(rows.where(~active)), "url-rows")
    return rows.drop("segs")


def purities(paths: DataFrame, weight: float = 5.0) -> DataFrame:
    """host, node, n, bad, good, purity of every template."""
    counts = [F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == 1).alias("bad"), F.count_if(F.col("label") == 0).alias("good")]
    own = stored(paths.groupBy(*NODE).agg(*counts), "url-templates")
    whole = own.agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).first()
    share = (whole["bad"] or 0) / max(1, (whole["bad"] or 0) + (whole["good"] or 0))
    hosts = own.groupBy("host").agg(((F.sum("bad") + weight * share) / (F.sum("bad") + F.sum("good") + weight)).alias("prior"))
    purity = (F.col("bad") + weight * F.col("prior")) / (F.col("bad") + F.col("good") + weight)
    return own.join(hosts, "host").select(*NODE, "n", "bad", "good", purity.alias("purity"))


def judge(paths: DataFrame, weight: float = 5.0, reject: float = 0.8, min_labelled: float = 0.0) -> DataFrame:
    """The rows of ``templates`` with purity and ``rejected`` of their template."""
    known = purities(paths, weight)
    bad = (F.col("bad") > 0) & (F.col("purity") >= reject) & (F.col("bad") + F.col("good") >= F.col("n") * min_labelled)
    known = stored(known.select(*NODE, "n", "purity", bad.alias("rejected")), "url-purities")
    total = known.agg(F.sum("n")).first()[0] or 0
    return spread_join(paths, known, NODE, total)


def decide(urls: DataFrame, rules: dict[str, str], url_col: str = "url", label: Column | None = None, carry: list[str] | None = None,
           weight: float = 5.0, reject: float = 0.8, min_labelled: float = 0.0, **options) -> DataFrame:
    """host, path, rule, verdict (allow or block), node, purity; with ``carry`` also ``row``. Without ``label`` the rules'
    verdicts are the labels of the urls they fit."""
    rule = longest_rule(F.col("host"), F.col("path"), rules)
    says = F.lit(None).cast("string")
    for r, v in rules.items():
        says = F.when(rule == r, F.lit(v)).otherwise(says)
    if label is None:
        label = F.when(says == "block", 1).when(says == "allow", 0)
    judged = judge(templates(urls, url_col, label, carry=carry, **options), weight, reject, min_labelled)
    verdict = F.coalesce(says, F.when(F.col("rejected"), F.lit("block")).otherwise("allow"))
    return judged.select(*["row"] * bool(carry), "host", "path", rule.alias("rule"), verdict.alias("verdict"), "node", "purity")
