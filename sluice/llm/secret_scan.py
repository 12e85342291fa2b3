"""Search for secrets through an inverted index of trigrams."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import common, trigrams


@dataclass(frozen=True)
class Rule:
    """A kind of secret.  *pattern* must mean the same to Java and to Python.

    The whole match is the span; a match of fewer than *least* characters in *group* is dropped
    (after it has been matched, so the search goes on behind it).
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = False


#: The three base patterns and their least lengths, then well-known token shapes.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24, True),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
)


def _occurs(pattern: str, text: Column) -> Column:
    return F.rlike(text, F.lit(pattern))


def build_index(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """Postings (trigram, key) of the trigrams that the rules' queries name.

    *docs* needs ``key``; a row has at most one posting a trigram, so the index is linear in
    the rows.  It is stored sorted by trigram within files: a query reads only its own lists.
    """
    asked = sorted({t for r in rules for term in trigrams.query_of(r.pattern) for t in term})
    lower = docs.select("key", F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("low"))
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in asked], F.lit(None).cast("string")))
    postings = lower.select("key", F.explode(held).alias("trigram"))
    return common.stage(postings.sortWithinPartitions("trigram", "key"), "postings")


def candidates(postings: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Rows (key, rules: bit mask) whose postings meet a rule's Boolean query.

    The lists of all trigrams asked for are intersected by key, each list one bit of a mask.
    Rules without a mandatory trigram are left out: they scan everything.
    """
    queries = [trigrams.query_of(r.pattern) for r in rules]
    asked = sorted({t for q in queries for term in q for t in term})
    words = [asked[k : k + 62] for k in range(0, len(asked), 62)]
    place = {t: (w, 1 << b) for w, part in enumerate(words) for b, t in enumerate(part)}
    bit = [F.bit_or(F.coalesce(*[F.when(F.col("trigram") == t, F.lit(1 << b)) for b, t in enumerate(part)], F.lit(0)).cast("long")).alias(f"m{w}") for w, part in enumerate(words)]
    masks = postings.where(F.col("trigram").isin(asked)).groupBy("key").agg(*bit)
    hit = F.lit(0)
    for k, q in enumerate(queries):
        if q == trigrams.ANY:
            continue
        met = F.lit(False)
        for term in q:
            need = [sum(place[t][1] for t in term if place[t][0] == w) for w in range(len(words))]
            all_ = F.lit(True)
            for w, n in enumerate(need):
                if n:
                    all_ = all_ & (F.col(f"m{w}").bitwiseAND(F.lit(n).cast("long")) == F.lit(n).cast("long"))
            met = met | all_
        hit = hit + F.when(met, F.lit(1 << k)).otherwise(F.lit(0))
    return masks.select("key", hit.cast("int").alias("rules")).where("rules > 0")


def _spans(order: int, rule: Rule, text: str = "body") -> Column:
    """Spans of one rule, in code points: what lies between matches and the matches add up.

    The sums before each match come from sums of 64 and of 4096 neighbours, so many matches in one text stay cheap.
    """
    p, n = rule.pattern, 1 << 6
    found = lambda group: F.transform(F.regexp_extract_all(F.col(text), F.lit(p), F.lit(group)), F.length)
    add = lambda xs, first, count: F.aggregate(F.slice(xs, first + 1, count), F.lit(0), lambda a, x: a + x)
    sums = lambda xs: F.transform(F.sequence(F.lit(0), F.floor(F.size(xs) / n).cast("int")), lambda k: add(xs, k * n, F.lit(n)))

    def spans(m: Column) -> Column:
        return F.transform(m["steps"], lambda step, i: common.let(
            add(m["tops"], F.lit(0), F.floor(i / n**2).cast("int"))
            + add(m["sums"], F.floor(i / n**2).cast("int") * n, F.floor(i / n).cast("int") % n) + add(m["steps"], i - i % n, i % n) + step,
            lambda stop: F.struct((stop - F.get(m["wholes"], i)).alias("start"), F.lit(order).alias("ord"), stop.alias("stop"), F.get(m["sizes"], i).alias("size")),
        ))

    def summed(m: Column) -> Column:
        return common.let(sums(m["steps"]), lambda s: F.struct(m["steps"].alias("steps"), m["wholes"].alias("wholes"), m["sizes"].alias("sizes"), s.alias("sums"), sums(s).alias("tops")))

    gaps = F.transform(F.split(F.col(text), p, -1), F.length)
    sizes = found(rule.group) if rule.group else found(0)
    matches = common.let(F.struct(gaps.alias("gaps"), found(0).alias("wholes"), sizes.alias("sizes")), lambda m: F.struct(
        F.transform(m["wholes"], lambda w, i: w + F.get(m["gaps"], i)).alias("steps"), m["wholes"].alias("wholes"), m["sizes"].alias("sizes"),
    ))
    return F.filter(common.let(common.let(matches, summed), spans), lambda s: s["size"] >= rule.least)


#: Code points of a block and spans of a group when texts are redacted.
_BLOCK, _GROUP = 1 << 12, 1 << 8
_SPAN = "array<struct<start:int,ord:int,stop:int,size:int>>"


def _scanned(docs: DataFrame, rules: tuple[Rule, ...], id_col: str, text_col: str) -> DataFrame:
    """row (all columns of *docs*), text, and spans."""
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("key"))
    with common.workspace(docs.sparkSession):
        index = build_index(keyed.select("key", "text"), rules)
        found = common.small(common.stage(candidates(index, rules), "candidates", keep=True))
    # a join that isn't by broadcast moves each text once
    rows = keyed.select("row", "key").join(found, "key", "left").withColumn("text", F.col(f"row.`{text_col}`")).withColumn("body", F.coalesce("text", F.lit("")))
    empty = F.array().cast(_SPAN)
    per_rule = []
    for k, r in enumerate(rules):
        may = F.coalesce(F.col("rules"), F.lit(0)).bitwiseAND(F.lit(1 << k)) != 0
        if trigrams.query_of(r.pattern) == trigrams.ANY:
            may = _occurs(r.pattern, F.col("body"))
        per_rule.append(F.when(may, _spans(k, r, "body").cast(_SPAN)).otherwise(empty))
    return rows.select("row", "text", F.array_sort(F.concat(*per_rule)).alias("spans"))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All of *docs* with ``secret_spans``: array of (start, ord, stop, size), by start, then rule order.

    Offsets are code points, the end exclusive; ord is the place of the rule in *rules*; size is
    the length that was tested.  An index of the trigrams that the rules need is built and stored,
    posting lists are intersected, and only candidates are verified with the regular expression;
    rules without a mandatory trigram run over every text.  A row's key is a hash of id and text:
    keys that collide can only add candidates, which verification then drops.
    Null text counts as empty and has no spans; repeated rows are each scanned; an empty table gives
    no rows; all columns of *docs* are kept (one called secret_spans is replaced).
    """
    out = _scanned(docs, rules, id_col, text_col)
    return out.select(*[F.col(f"row.`{c}`") for c in docs.columns if c.lower() != "secret_spans"], F.col("spans").alias("secret_spans"))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """*docs* with every span replaced by its kind in brackets; where spans overlap, the first counts
    and the rest of a longer one goes with it.  All columns are kept, whatever they are called; null texts stay null.

    A text is cut into blocks once and its spans are taken in groups, so that a span costs a block's length, not the text's."""
    kinds = F.array(*[F.lit(f"[{r.kind}]") for r in rules])
    text, none = F.col("text"), F.array().cast("array<string>")

    def cut(blocks: Column, a: Column, b: Column) -> Column:
        """The text from a to b."""
        def part(k: Column) -> Column:
            first = F.greatest(a - k * _BLOCK, F.lit(0))
            return F.substring(F.get(blocks, k), first + 1, F.least(b - k * _BLOCK, F.lit(_BLOCK)) - first)

        return F.array_join(F.transform(F.sequence(F.floor(a / _BLOCK).cast("int"), F.floor(b / _BLOCK).cast("int")), part), "")

    def replaced(blocks: Column) -> Column:
        at_ = lambda at, out: F.struct(at.alias("at"), out.alias("out"))
        step = lambda a, s: F.when(
            s["start"] >= a["at"], at_(s["stop"], F.array_append(a["out"], F.concat(cut(blocks, a["at"], s["start"]), F.get(kinds, s["ord"])))),
        ).otherwise(at_(F.greatest(a["at"], s["stop"]), a["out"]))

        def group(a: Column, k: Column) -> Column:
            some = F.aggregate(F.slice("spans", k * _GROUP + 1, _GROUP), at_(a["at"], none), step)
            return common.let(some, lambda g: at_(g["at"], F.array_append(a["out"], F.array_join(g["out"], ""))))

        groups = F.sequence(F.lit(0), F.floor((F.size("spans") - 1) / _GROUP).cast("int"))
        return F.aggregate(groups, at_(F.lit(0), none), group, lambda a: F.concat(F.array_join(a["out"], ""), cut(blocks, a["at"], F.length(text))))

    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.length(text) / _BLOCK).cast("int")), lambda k: F.substring(text, k * _BLOCK + 1, F.lit(_BLOCK)))
    done = common.let(blocks, replaced)
    new = F.when(F.size("spans") > 0, done).otherwise(text)
    return _scanned(docs, rules, id_col, text_col).select(*[new.alias(c) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns])


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every whole text."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    kinds = F.array(*[F.lit(r.kind) for r in RULES])
    say = lambda s: F.concat_ws(":", F.get(kinds, s["ord"]), s["start"].cast("string"), s["stop"].cast("string"))
    of = lambda k: F.size(F.filter("secret_spans", lambda s: s["ord"] == k)).cast("long")
    n_base = sum(r.base for r in RULES)
    base = F.filter("secret_spans", lambda s: s["ord"] < n_base)
    return found.select(
        "doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"),
        F.sha2(F.array_join(F.transform(base, say), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("secret_spans", say), ",").alias("spans"),
    )


def _found_sql(k: int, rule: Rule) -> str:
    p = rule.pattern.replace("'", "''")
    return f"""  SELECT row_id, {k} AS ord, '{rule.kind}' AS kind, {rule.least} AS least, string_split_regex(body, '{p}') AS gaps,
         regexp_extract_all(body, '{p}', 0) AS wholes, regexp_extract_all(body, '{p}', {rule.group}) AS sizes FROM t"""


OP5_SQL = f"""
WITH t AS (SELECT doc_id, row_number() OVER () AS row_id, coalesce(text, '') AS body FROM documents),
found AS (
{" UNION ALL ".join(_found_sql(k, r) for k, r in enumerate(RULES))}
),
placed AS (SELECT *, unnest(range(1, len(wholes) + 1)) AS i FROM found WHERE len(wholes) > 0),
spans AS (
  SELECT row_id, ord, kind, length(wholes[i]) AS size,
         list_sum([length(x) for x in gaps[1:i]]) + coalesce(list_sum([length(x) for x in wholes[1:i - 1]]), 0) AS start
  FROM placed WHERE length(sizes[i]) >= least
),
named AS (SELECT *, kind || ':' || CAST(start AS BIGINT) || ':' || CAST(start + size AS BIGINT) AS name FROM spans),
said AS (
  SELECT row_id, count(*) FILTER (ord = 0) AS n_assign, count(*) FILTER (ord = 1) AS n_access, count(*) FILTER (ord = 2) AS n_hex,
         string_agg(name, ',' ORDER BY start, ord) FILTER (ord < 3) AS base, string_agg(name, ',' ORDER BY start, ord) AS spans
  FROM named GROUP BY row_id
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN said USING (row_id)
"""
