"""Secrets in texts, told apart by corpus-wide ownership.

Patterns find candidates in every text. The hash of each candidate's value is
counted over distinct repositories and owners: a value under many owners, or in many
repositories of few owners, is a copied example; one that stays with few and looks random is a live
credential. Such values are reported wherever they stand, also without a keyword.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxframe.functions.arrays import let
from voxframe.llm.common import ROW, cut, numbered

# The base patterns, in the order in which kinds are listed, with the length to reach
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ["assign", "access", "hex", "owned"]
# The same matches as ACCESS and HEX with the lengths put in: both take the whole run of their
# characters, and a run too short at its first match holds no longer one after it.
ACCESS_LONG = r"AKIA[A-Z0-9]{14,}"
HEX_LONG = r"[0-9a-f]{16,}"
ASSIGN_VALUE = 12
# A run that may be a credential without any keyword
RUN = r"[A-Za-z0-9+/_-]{20,}"
DISTINCT_CHARS = 10
EXAMPLE_OWNERS = 3
EXAMPLE_REPOS = 10
# Matches whose places are added up one after another
CHUNK = 128


def _matches(text: Column, pattern: str, kind: int, least: int = 0) -> Column:
    """array<struct<start, kind, end, value>> of a pattern's leftmost matches that do not overlap.

    Positions count code points. They come from the lengths of the pieces between
    the matches and of the matches, which the same regex engine cuts. Lengths are added up per CHUNK
    of matches, then over the chunks, then inside each, so that no long array is copied for every match.
    """
    group = 2 if least else 0
    parts = F.arrays_zip(
        F.split(text, pattern, -1).alias("piece"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("whole"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"),
    )
    entry = "struct<start:int,kind:int,end:int,value:string>"
    length = lambda part: F.length(part["piece"]) + F.coalesce(F.length(part["whole"]), F.lit(0))

    def appended(state: Column, at: Column, item: Column | None, kept: Column | None = None) -> Column:
        more = F.concat(state["found"], F.array(item))
        return F.struct(at.alias("at"), (more if kept is None else F.when(kept, more).otherwise(state["found"])).alias("found"))

    def begins(chunks: Column) -> Column:
        """The place where each chunk begins."""
        sums = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda s, part: s + length(part)))
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("found"))
        return F.aggregate(sums, start, lambda s, n: appended(s, s["at"] + n, s["at"]), lambda s: s["found"])

    def step(state: Column, part: Column) -> Column:
        begin = state["at"] + F.length(part["piece"])
        end = begin + F.coalesce(F.length(part["whole"]), F.lit(0))
        made = F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), part["value"].alias("value"))
        return appended(state, end, made, part["whole"].isNotNull() & (F.length(part["value"]) >= least))

    def inside(chunk: Column, begin: Column) -> Column:
        start = F.struct(begin.alias("at"), F.array().cast(f"array<{entry}>").alias("found"))
        return F.aggregate(chunk, start, step, lambda s: s["found"])

    def cut_up(all_: Column) -> Column:
        firsts = F.sequence(F.lit(1), F.size(all_), F.lit(CHUNK))
        return F.transform(firsts, lambda i: F.slice(all_, i, F.lit(CHUNK)))

    found = let(parts, lambda all_: let(cut_up(all_), lambda chunks: F.flatten(F.zip_with(chunks, begins(chunks), inside))))
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(f"array<{entry}>"))


def live_looking(value: Column) -> Column:
    """Digits and letters both, and many different characters: no word, no number, no rule of dashes."""
    chars = F.size(F.array_distinct(F.split(value, "")))
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (chars >= DISTINCT_CHARS)


def spans_text(spans: Column) -> Column:
    """kind:start:end by start, then kind, joined by commas."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    shown = F.transform(F.array_sort(spans), lambda s: F.concat_ws(
        ":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(shown, ",")


def find_candidates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", owner: str = "source") -> DataFrame:
    """(__row, doc_id, owner, repo, base, extra): the candidates of every text, values only as hashes."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    base = F.concat(_matches(whole, ASSIGN, 0, ASSIGN_VALUE), _matches(whole, ACCESS_LONG, 1), _matches(whole, HEX_LONG, 2))
    runs = _matches(whole, RUN, 3)
    free = lambda r: ~F.exists(F.col("base"), lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"]))
    found = docs.select(
        F.col(doc_id).alias("doc_id"), F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("owner"),
        F.md5(text).alias("repo"), base.alias("base"), runs.alias("runs"),
    )
    hashed = lambda c: F.transform(c, lambda s: F.struct(
        s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"),
        F.substring(F.sha2(s["value"], 256), 1, 32).alias("hash"), live_looking(s["value"]).alias("live")))
    extra = F.filter("runs", lambda r: live_looking(r["value"]) & free(r))
    return numbered(found.select("doc_id", "owner", "repo", hashed(F.col("base")).alias("base"), hashed(extra).alias("extra")))


def ownership(candidates: DataFrame) -> DataFrame:
    """(hash, owners, repos): distinct owners and repositories of every candidate value.

    Equal texts are one repository, with the first of their owners. Distinct (hash, repository) first, then sums
    of the few rows left, all combined before each shuffle: a value in any share of the texts does not pile up.
    """
    each = candidates.select("owner", "repo", F.explode(F.concat("base", "extra")).alias("s"))
    of_repo = each.groupBy("s.hash", "repo").agg(F.min("owner").alias("owner"))
    of_owner = of_repo.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("n"))
    return of_owner.groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("n").alias("repos"))


def find_secrets(
    docs: DataFrame, example_owners: int = EXAMPLE_OWNERS, example_repos: int = EXAMPLE_REPOS,
    doc_id: str = "doc_id", text: str = "text", owner: str = "source",
) -> DataFrame:
    """(doc_id, base, all_spans, n_live, n_example), one row for each document.

    A value is an example if it stands under `example_owners` owners or more, or in `example_repos`
    repositories or more, whoever owns them. The text is the repository, so copies of a
    document make no example of what it holds; `owner` is its owner. `base` holds the pattern matches, all of
    them, `all_spans` also the runs that look like a credential, are no example and
    overlap no base span. `n_live` counts the spans with such a value, `n_example`
    those with an example. A NULL owner is one of its own, a NULL or empty text has no spans.
    """
    rows = cut(find_candidates(docs, doc_id, text, owner))
    copied = (F.col("owners") >= example_owners) | (F.col("repos") >= example_repos)
    owned = ownership(rows).withColumn("example", copied)
    each = rows.select(ROW, F.explode(F.concat("base", "extra")).alias("s")).withColumn("hash", F.col("s.hash"))
    live = ~F.col("example") & F.col("s.live")
    judged = (
        each.join(owned.select("hash", "example"), "hash")
        .groupBy(ROW).agg(
            F.count_if(live).alias("n_live"), F.count_if("example").alias("n_example"),
            F.collect_list(F.when((F.col("s.kind") == 3) & live, F.col("s"))).alias("added"),
        )
    )
    joined = rows.join(judged, ROW, "left")
    added = F.coalesce("added", F.filter("base", lambda s: F.lit(False)))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return joined.select("doc_id", "base", F.concat("base", added).alias("all_spans"), zero("n_live"), zero("n_example"))


def digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example) of every document."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return find_secrets(docs).select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"), spans_text(F.col("all_spans")).alias("spans"),
        "n_live", "n_example",
    )
