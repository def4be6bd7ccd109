"""Secret scans with corpus-wide ownership frequency, in DataFrame operations only.

Candidates are the matches of ``KINDS`` in whole texts.  Their hashes are counted over the corpus by distinct repositories and
owners.  A value is a widely copied example if ``example_owners`` owners or more hold it, or two or more in ``example_repositories`` repositories or more;
one that a single owner holds, in however many repositories, looks live and owner-specific, and so does one that few owners share in few
repositories.  Base kinds (assign, access, hex) are always reported; of the further kinds (``broad``) only values that look live are.

Positions come from the gaps between matches: ``split`` gives the gaps, ``regexp_extract_all`` the matches, and a running sum of their lengths in code
points the spans.  Texts are scanned once; from then on there are numbered rows and, one row each, their matches, so the sum is a window over a row's
matches and costs time linear in them (a text of 100,000 matches is 100,000 small rows).  Counting combines before each shuffle (value, owner and repository
first, then value), so a value that a third of the corpus holds is one row per task; the join that brings verdicts back is an equi-join that
adaptive execution may split.

Defined cases: null text is empty; a null owner or repository counts as one of its own; repeated rows get equal spans and count once;
texts without matches have no spans; an empty table gives no rows; a span found by two broad kinds is reported for each; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm.common import cut

_ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: kind -> (pattern of a match, group that is the value, least length of the value).  Fixed values.
KINDS = {
    "assign": (_ASSIGN, 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    # maximal runs, so the least length can stand in the pattern
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}
#: Further kinds, reported where their value looks live.
BROAD = {
    "prefixed": (r"\b(?:ghp_|gho_|ghs_|github_pat_|glpat-|xox[abprs]-|sk_live_|sk-|AIza|hf_)[A-Za-z0-9_-]{16,}", 0, 16),
    "jwt": (r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 24),
    "login": (r"\b[a-z][a-z0-9+.-]{1,20}://[^\s:/@]{1,200}:[^\s:/@]{1,200}@", 0, 8),
}
#: A text that lacks these has no match of any kind; the scan of most texts ends here.
_HINT = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]|AKIA[A-Z0-9]|[0-9a-f]{24}|\beyJ|://[^\s:/@]{1,200}:|\b(?:gh[pos]_|github_pat_|glpat-|xox[abprs]-|sk_live_|sk-|AIza|hf_)"""


def matches_of(text: Column, kind: str, pattern: str, group: int) -> Column:
    """array<struct<kind, gap, len, value>> of all matches in order: the code points before each since the last one, its length, and its value."""
    whole, value, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.split(text, pattern, -1)
    # the gap after the last match has none, so it is cut off
    pairs = F.arrays_zip(whole.alias("whole"), value.alias("value"), F.slice(gaps, F.lit(1), F.size(whole)).alias("gap"))
    made = F.transform(pairs, lambda m: F.struct(F.lit(kind).alias("kind"), F.length(m["gap"]).alias("gap"), F.length(m["whole"]).alias("len"), m["value"].alias("value")))
    return F.when(text.rlike(pattern), made).otherwise(F.array().cast(_MATCHES))


_MATCHES = "array<struct<kind:string,gap:int,len:int,value:string>>"


def scan(documents: DataFrame, key: str = "doc_id", text_col: str = "text", owner_col: str = "source", repository_col: str = "doc_id", kinds: dict | None = None, broad: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """(row, key, owner, repository, found) of every row, and (row, owner, repository, kind, start, stop, value, value_hash, base) of every finding; one pass over the texts."""
    kinds, broad = KINDS if kinds is None else kinds, BROAD if broad is None else broad
    every = kinds | broad
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    found = F.when(text.rlike(_HINT), F.concat(*[matches_of(text, k, pattern, group) for k, (pattern, group, _) in every.items()])) if every else F.lit(None)
    rows = documents.select(
        F.monotonically_increasing_id().alias("row"), F.col(f"`{key}`").alias("key"), F.col(f"`{owner_col}`").cast("string").alias("owner"), F.col(f"`{repository_col}`").cast("string").alias("repository"), F.coalesce(found.cast(_MATCHES), F.array().cast(_MATCHES)).alias("found")
    )
    rows = cut(rows)  # which fixes the numbers of the rows
    each = rows.where(F.size("found") > 0).select("row", "owner", "repository", F.posexplode("found").alias("at", "m")).select("row", "owner", "repository", "at", "m.*")
    running = Window.partitionBy("row", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    least = F.create_map(*[F.lit(x) for k, (_, _, n) in every.items() for x in (k, n)]) if every else F.lit(None).cast("map<string,int>")
    spans = each.withColumn("stop", F.sum(F.col("gap").cast("long") + F.col("len")).over(running)).where(F.length("value") >= F.element_at(least, F.col("kind")))
    return rows.withColumn("found", F.size("found") > 0), spans.select("row", "owner", "repository", "kind", (F.col("stop") - F.col("len")).alias("start"), "stop", "value", F.sha2(F.encode("value", "UTF-8"), 256).alias("value_hash"), F.col("kind").isin(*kinds).alias("base"))


def ownership(held: DataFrame, example_owners: int = 3, example_repositories: int = 10) -> DataFrame:
    """(value_hash, n_repositories, n_owners, verdict) from (value_hash, owner, repository): ``example`` if widely copied, else ``live``."""
    # null owners and repositories are one each, which a distinct count would leave out
    both = held.groupBy("value_hash", "owner", "repository").agg(F.lit(1).alias("one"))
    owners = both.groupBy("value_hash", "owner").agg(F.lit(1).alias("one")).groupBy("value_hash").agg(F.count("one").alias("n_owners"))
    repositories = both.groupBy("value_hash", "repository").agg(F.lit(1).alias("one")).groupBy("value_hash").agg(F.count("one").alias("n_repositories"))
    copied = (F.col("n_owners") >= example_owners) | ((F.col("n_owners") >= 2) & (F.col("n_repositories") >= example_repositories))
    return owners.join(repositories, "value_hash").select("value_hash", "n_repositories", "n_owners", F.when(copied, "example").otherwise("live").alias("verdict"))


def scan_secrets(documents: DataFrame, example_owners: int = 3, example_repositories: int = 10, **columns) -> tuple[DataFrame, DataFrame]:
    """The numbered rows, and one row per finding: (row, owner, repository, kind, start, stop, value_hash, base, n_repositories, n_owners, verdict)."""
    rows, spans = scan(documents, **columns)
    spans = cut(spans.drop("value"))
    return rows, spans.join(ownership(spans, example_owners, example_repositories), "value_hash")


def joined(spans: Column, order: dict[str, int]) -> Column:
    """``kind:start:stop`` by start, then the order of kinds, comma-joined; ``spans`` are (start, kind, stop)."""
    rank = F.create_map(*[F.lit(x) for k, n in order.items() for x in (k, n)])
    by = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.element_at(rank, s["kind"]).alias("rank"), s["kind"].alias("kind"), s["stop"].alias("stop"))))
    return F.array_join(F.transform(by, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def secret_spans(documents: DataFrame, example_owners: int = 3, example_repositories: int = 10, key: str = "doc_id", **columns) -> DataFrame:
    """(key, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example) of every row."""
    rows, findings = scan_secrets(documents, example_owners, example_repositories, key=key, **columns)
    order = {k: i for i, k in enumerate([*KINDS, *BROAD])}
    span, live = F.struct("start", "kind", "stop"), F.col("verdict") == "live"
    per_row = findings.groupBy("row").agg(
        *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in KINDS], F.collect_list(F.when(F.col("base"), span)).alias("base"), F.collect_list(F.when(F.col("base") | live, span)).alias("all"), F.count_if(live).alias("n_live"), F.count_if(F.col("verdict") == "example").alias("n_example")
    )
    none = F.array().cast("array<struct<start:bigint,kind:string,stop:bigint>>")
    # rows without a match need no join
    made = rows.where("found").select("row", "key").join(per_row, "row", "left").unionByName(rows.where("not found").select("row", "key"), allowMissingColumns=True)
    made = made.withColumns({"base": F.coalesce("base", none), "all": F.coalesce("all", none)})
    numbers = {n: F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in (*(f"n_{k}" for k in KINDS), "n_live", "n_example")}
    live_example = [numbers.pop(n) for n in ("n_live", "n_example")]
    return made.select(F.col("key").alias(key), *numbers.values(), F.sha2(F.encode(joined(F.col("base"), order), "UTF-8"), 256).alias("base_sha256"), joined(F.col("all"), order).alias("spans"), *live_example)
