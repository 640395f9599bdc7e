"""Name resolution and fuzzy names."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

#: Tiers of resolution, best first.
TIERS = ("id", "title", "basename", "title_ci", "alias", "substring")


def strict_aliases(frontmatter: Column | str) -> Column:
    """``aliases`` as a list, or a text as one alias (the resolver's reading)."""
    v = X.valid_json(frontmatter)
    listed, one = F.try_variant_get(v, "$.aliases", "array<string>"), F.try_variant_get(v, "$.aliases", "string")
    return F.coalesce(listed, F.when(one.isNotNull(), F.array(one)), F.array().cast("array<string>"))


def loose_aliases(frontmatter: Column | str) -> Column:
    """``aliases`` and ``alias``, lists or comma-separated texts (the finder's reading)."""
    v = X.valid_json(frontmatter)
    parts = []
    for key in ("aliases", "alias"):
        listed, one = F.try_variant_get(v, f"$.{key}", "array<string>"), F.try_variant_get(v, f"$.{key}", "string")
        parts.append(F.coalesce(listed, F.split(one, ","), F.array().cast("array<string>")))
    return F.array_distinct(F.filter(F.transform(F.concat(*parts), lambda a: F.trim(a)), lambda a: a != ""))


def resolve(notes: DataFrame, name: str) -> DataFrame:
    """The notes of the best tier that has any, with the tier; all in one pass and one window over what matched."""
    low = name.lower()
    ci_alias = F.exists(strict_aliases("frontmatter"), lambda a: F.lower(a) == low)
    tier = (
        F.when(F.col("id").isin(name, name + ".md"), 0)
        .when(F.col("title") == name, 1)
        .when(X.basename("id").isin(name, name.removesuffix(".md") + ".md"), 2)
        .when(F.lower("title") == low, 3)
        .when(ci_alias, 4)
        .when(F.lower("title").contains(low), 5)
    )
    hits = notes.select("id", "title", tier.alias("tier")).where("tier is not null")
    best = hits.agg(F.min("tier").alias("best"))
    return hits.join(F.broadcast(best), F.col("tier") == F.col("best")).select("id", "title", "tier")  # one row is broadcast


def resolve_single(notes: DataFrame, name: str, allow_stub: bool = False) -> str:
    """The one note a name stands for; an error names up to ten candidates where it is not clear."""
    rows = resolve(notes, name).orderBy("id").limit(11).collect()
    if not rows:
        raise LookupError(f"no note is called {name!r}")
    if len(rows) > 1 and rows[0].tier >= 3:
        raise LookupError(f"{name!r} is ambiguous: " + ", ".join(r.id for r in rows[:10]))
    if rows[0].id.startswith("_stub/") and not allow_stub:
        raise LookupError(f"{name!r} is only a placeholder")
    return rows[0].id


def similarity(a: Column, b: Column) -> Column:
    """1 - edits / longer length, case ignored."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(F.lower(a), F.lower(b)) / longest)


def _span(text: Column, query: str) -> Column:
    """Length of the stretch in which the query's characters come one after the other, 0 if they do not; one fold over the text."""
    wanted = F.lit(list(query))
    state = F.struct(F.lit(0).alias("k"), F.lit(0).alias("first"), F.lit(0).alias("last"))
    chars = F.transform(F.split(text, ""), lambda c, i: F.struct(c.alias("c"), (i + 1).alias("i")))
    step = lambda s, x: F.when(
        x["c"] == F.try_element_at(wanted, s["k"] + 1),
        F.struct((s["k"] + 1).alias("k"), F.when(s["k"] == 0, x["i"]).otherwise(s["first"]).alias("first"), x["i"].alias("last")),
    ).otherwise(s)
    return F.aggregate(chars, state, step, lambda s: F.when(s["k"] == len(query), s["last"] - s["first"] + 1).otherwise(0))


def score_name(candidate: Column, query: str) -> Column:
    """1 equal, .9 prefix, .85 at a word's start (behind white space or one of ``-_/.``), .8 inside, .7 all words; else the better of
    .4-.6 as a subsequence and likeness x .6 from .6 on.  An empty query or name scores 0."""
    q = query.lower().strip(X.JS_SPACE)
    if not q:
        return F.lit(0.0)
    c = F.lower(candidate)
    at = F.locate(q, c)
    before = F.substring(c, at - 1, F.lit(1))
    words = q.split()
    all_words = X.all_of([c.contains(w) for w in words]) if len(words) > 1 else F.lit(False)
    span = _span(c, q.replace(" ", ""))
    like = similarity(c, F.lit(q))
    loose = F.greatest(F.when(span > 0, 0.4 + 0.2 * len(q) / span).otherwise(0.0), F.when(like >= 0.6, like * 0.6).otherwise(0.0))
    return F.round(
        F.when(F.coalesce(c, F.lit("")) == "", 0.0)
        .when(c == q, 1.0)
        .when(c.startswith(q), 0.9)
        .when((at > 1) & before.rlike(r"(?U)[\s\uFEFF\-_/.]"), 0.85)
        .when(at > 0, 0.8)
        .when(all_words, 0.7)
        .otherwise(loose),
        3,
    )


def find_by_name(notes: DataFrame, query: str, folder: str | None = None, limit: int = 20) -> DataFrame:
    """Best of name, title and aliases; better scores first, then shorter paths."""
    names = notes.where(X.in_folder("id", folder)).select("id", "title", X.stem("id").alias("name"), loose_aliases("frontmatter").alias("aliases"))
    scored = names.select(
        "id", "title",
        F.struct(score_name(F.col("name"), query).alias("score"), F.lit(0).alias("turn"), F.lit("name").alias("on"), F.lit(None).cast("string").alias("alias")).alias("n"),
        F.struct(score_name(F.coalesce("title", F.lit("")), query).alias("score"), F.lit(-1).alias("turn"), F.lit("title").alias("on"), F.lit(None).cast("string").alias("alias")).alias("t"),
        F.array_max(F.transform("aliases", lambda a, i: F.struct(score_name(a, query).alias("score"), (-2 - i).alias("turn"), F.lit("alias").alias("on"), a.alias("alias")))).alias("a"),
    )
    best = scored.select("id", "title", F.greatest("n", "t", "a").alias("b")).where("b.score > 0")
    return best.select("id", "title", F.col("b.score").alias("score"), F.col("b.on").alias("matched_on"), F.col("b.alias").alias("alias")).orderBy(F.desc("score"), F.length("id"), "id").limit(limit)


def fuzzy_find(notes: DataFrame, needle: str, threshold: float = 0.7) -> DataFrame:
    """``id, line, text, score``.  A note that holds the needle, case ignored, gives each place it does, with score 1; any other gives per
    line the stretch of words most like it, if that reaches the threshold, the first of equals, its words joined by one blank."""
    low, most = needle.lower(), max(1, len(needle.split())) + 2
    if not low:
        return notes.select("id", F.lit(0).alias("line"), F.lit("").alias("text"), F.lit(0.0).alias("score")).limit(0)
    holds = F.lower("content").contains(low)
    parts = F.split(F.lower("content"), F.lit(re.sub(r"([^\w\s])", r"\\\1", low)), -1)
    place = "struct<at: int, line: int>"
    start = F.struct(F.lit(0).alias("at"), F.lit(1).alias("line"), F.array().cast(f"array<{place}>").alias("out"))

    def step(s: Column, p: Column) -> Column:
        at, line = s["at"] + F.length(p), s["line"] + (F.length(p) - F.length(F.replace(p, F.lit("\n"))))
        return F.struct((at + len(low)).alias("at"), (line + low.count("\n")).alias("line"), F.concat(s["out"], F.array(F.struct(at.alias("at"), line.alias("line")))).alias("out"))

    places = F.aggregate(F.slice(parts, F.lit(1), F.size(parts) - 1), start, step, lambda s: s["out"])
    exact = notes.where(holds).select("id", "content", F.explode(places).alias("p"))
    exact = exact.select("id", "p.line", F.substring("content", F.col("p.at") + 1, F.lit(len(low))).alias("text"), F.lit(1.0).alias("score"))

    lines = notes.where(~holds).select("id", F.posexplode(F.split("content", "\n")).alias("at", "text")).where(F.trim("text") != "")
    words = F.filter(F.split("text", r"(?U)[\s\uFEFF]+"), lambda w: w != "")

    def run(i: Column, n: Column) -> Column:
        return F.struct(F.array_join(F.slice(words, i, n), " ").alias("text"), (-i).alias("first"), (-n).alias("size"))

    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.size(words)), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(most), F.size(words) - i + 1)), lambda n: run(i, n))))
    # a stretch too long or too short cannot reach the threshold, so its edits are not counted
    near = F.filter(runs, lambda r: F.least(F.length(r["text"]), F.lit(len(needle))) >= F.greatest(F.length(r["text"]), F.lit(len(needle))) * threshold - 1e-9)
    best = F.array_max(F.transform(near, lambda r: F.struct(similarity(r["text"], F.lit(needle)).alias("score"), r["first"].alias("first"), r["size"].alias("size"), r["text"].alias("text"))))
    like = lines.where(F.size(words) > 0).select("id", (F.col("at") + 1).alias("line"), best.alias("b")).where(F.col("b.score") >= threshold)
    return exact.unionByName(like.select("id", "line", "b.text", F.round("b.score", 6).alias("score")))


def link_paths(raw: DataFrame, notes: DataFrame) -> DataFrame:
    """``source_id, raw, path``: direct path, else a note whose stem is the link's last part as written: by path prefix, in the
    referrer's folder, or the first in order.

    Two equi-joins and a first-of-group aggregate; nothing is compared pairwise.
    """
    bare = F.regexp_replace("raw", r"\.md$", "")
    wanted = raw.select("source_id", "raw").distinct().withColumn("want", F.concat(bare, F.lit(".md")))
    direct = wanted.join(notes.select(F.col("id").alias("want")), "want", "left_semi").select("source_id", "raw", F.col("want").alias("path"))
    rest = wanted.join(direct.select("source_id", "raw"), ["source_id", "raw"], "left_anti").withColumn("stem", X.basename("raw"))
    candidates = rest.join(notes.select("id", X.stem("id").alias("stem")), "stem")
    turn = F.when(F.col("raw").contains("/") & F.col("id").startswith(bare), 0).when(X.dirname("id") == X.dirname("source_id"), 1).otherwise(2)
    ranked = candidates.groupBy("source_id", "raw").agg(F.min(F.struct(turn.alias("turn"), "id")).alias("x")).select("source_id", "raw", F.col("x.id").alias("path"))
    found = direct.unionByName(ranked)
    return wanted.select("source_id", "raw").join(found, ["source_id", "raw"], "left")


def first_spelling(rows: DataFrame, value: str, order: str) -> DataFrame:
    """The first spelling of each value, case ignored."""
    return rows.groupBy(F.lower(value).alias("key")).agg(F.min_by(value, order).alias(value))


def first_rows(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in an order; an aggregate, so nothing is sorted."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("x")).select(*keys, "x.*")


def ranked_by(rows: DataFrame, keys: list) -> DataFrame:
    """A short list with its places from 1 in an order."""
    return rows.withColumn("place", F.row_number().over(Window.orderBy(*keys)).cast("long"))


def ranked(rows: DataFrame, score: str, key: str) -> DataFrame:
    """Rank from 0 of a short result list."""
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), key)) - 1)
