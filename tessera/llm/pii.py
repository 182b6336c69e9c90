"""Personal data by rules and bootstrapped contextual extraction (operator 8).

Only DataFrame and SQL functions.  Base rules give the seed entities of four
kinds; a fifth kind, secrets, is seeded by long random-looking strings that a
name is set to.  Words left and right of an entity, and the name that it is set
to, are lexical patterns; the same patterns beside other identifier-like tokens
make a pattern-instance graph.  In each generation a pattern's confidence (the
belief in its distinct values over their number and one) and the belief in a
value (chance that not all of its accepted patterns err) are computed in turns;
values believed in are seeds of the next generation, so new patterns may follow
from them.  Accepted patterns name identifiers that no rule knows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.storage import materialize

#: Kinds of the base rules; the method may add spans of these and of LEARNED kinds.
KINDS = ("email", "ip", "card", "phone")
LEARNED = (*KINDS, "secret")

# The base rules' patterns, with possessive repeats and look-behinds that leave
# the matches as they are but keep long runs of one class linear.
_RULES = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# cheap conditions that every text with a valid match meets
_GATES = {
    "email": "contains(text, '@')",
    "ip": r"text rlike '[0-9][.][0-9]++[.][0-9]++[.][0-9]'",
    "card": r"text rlike '[0-9](?:[\\x20-]?[0-9]){15}'",
    "phone": r"text rlike '[+][0-9][\\x20().0-9-]'",
}
_VALID = {
    "email": "true",
    "ip": "forall(split(x.value, '[.]'), p -> coalesce(try_cast(concat('0', trim(LEADING '0' FROM p)) AS INT) <= 255, false))",
    "card": "length(translate(x.value, ' -', '')) BETWEEN 16 AND 19 AND aggregate(transform(split(reverse(translate(x.value, ' -', '')), ''), (c, i) -> coalesce(try_cast(c AS INT), 0) * (1 + i % 2) - IF(i % 2 = 1 AND coalesce(try_cast(c AS INT), 0) > 4, 9, 0)), 0, (a, v) -> a + v) % 10 = 0",
    "phone": "length(translate(x.value, '+ ().-', '')) BETWEEN 8 AND 15",
}
_TOKEN = r"(?<!\S)(?=\S*?[0-9@])\S++"
#: A secret's seed: long, of letters and digits, and a name is set to it.
_SECRET = "t.value rlike '^[A-Za-z0-9+/_=-]{32,}$' AND t.value rlike '[0-9]' AND t.value rlike '[A-Za-z]' AND exists(t.at, c -> startswith(c, 'set:'))"
_SPAN = "array<struct<kind:int,s:int,e:int,value:string,at:array<string>>>"


@dataclass(frozen=True)
class Params:
    """generations of scoring; support: distinct believed values of a pattern; confidence of patterns and belief in values that are enough; reach: characters looked at on either side of an entity."""

    generations: int = 3
    support: int = 5
    confidence: float = 0.85
    belief: float = 0.8
    reach: int = 64


def _patterns(reach: int) -> str:
    """SQL: the lexical patterns between ``p``, the text before an entity, and ``q``, the text after it."""
    words = f"filter(split(lower(regexp_replace(right(p, {reach}), '[^\\\\p{{L}}]+', ' ')), ' '), w -> w <> '')"
    two = f"transform(array({words}), ws -> CASE WHEN size(ws) > 1 THEN concat('two:', ws[size(ws) - 2], ' ', ws[size(ws) - 1]) END)[0]"
    one = f"transform(array({words}), ws -> CASE WHEN size(ws) > 0 THEN concat('one:', ws[size(ws) - 1]) END)[0]"
    set_ = f"nullif(concat('set:', regexp_extract(lower(right(p, {reach})), '([\\\\p{{L}}_][\\\\p{{L}}\\\\p{{N}}_-]*)[\"\\']?\\\\s*[=:][\\\\s\"\\']*$', 1)), 'set:')"
    after = f"nullif(concat('after:', regexp_extract(lower(left(q, {reach})), '^[^\\\\p{{L}}]*(\\\\p{{L}}+)', 1)), 'after:')"
    return f"array_compact(array({two}, {one}, {set_}, {after}))"


def _let(value: str, name: str, body: str) -> str:
    """SQL: ``body`` in which ``name`` is the value, worked out once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _running(items: str, join: str) -> str:
    """SQL: running values of an array of numbers under an associative ``join`` of x and y.

    An array that grows by an item is copied each time, so items run in blocks
    of about the square root of their number, and the blocks' ends in turn.
    """
    along = lambda xs: f"aggregate({xs}, cast(array() AS array<int>), (acc, y) -> concat(acc, array(CASE WHEN size(acc) = 0 THEN y ELSE {_let('element_at(acc, -1)', 'x', join)} END)))"
    blocks = f"transform(sequence(0, cast((size(ns) - 1) div w AS INT)), b -> {along('slice(ns, b * w + 1, w)')})"
    carried = f"flatten(transform(own, (l, i) -> CASE WHEN i = 0 THEN l ELSE {_let('ends[i - 1]', 'x', f'transform(l, y -> {join})')} END))"
    body = _let(blocks, "own", _let(along("transform(own, l -> element_at(l, -1))"), "ends", carried))
    sized = _let("cast(ceil(sqrt(size(ns))) AS INT)", "w", body)
    return _let(items, "ns", f"CASE WHEN size(ns) = 0 THEN ns ELSE {sized} END")


def _matches(pattern: str, kind: int, reach: int) -> str:
    """SQL: spans of all matches, by the lengths of what lies between them."""
    quoted = "r'" + pattern.replace("'", "\\'") + "'"
    gaps, hits = f"split(text, {quoted}, -1)", f"regexp_extract_all(text, {quoted}, 0)"
    zipped = f"transform(array({gaps}), g -> zip_with(zip_with(slice(g, 1, size(g) - 1), {hits}, (p, h) -> struct(p, h)), slice(g, 2, size(g) - 1), (x, q) -> transform(array(x.p), p -> struct(length(p) AS gap, length(x.h) AS len, x.h AS value, {_patterns(reach)} AS at))[0]))[0]"
    ends = _running("transform(zs, z -> z.gap + z.len)", "x + y")
    spans = f"cast(zip_with(zs, {ends}, (z, e) -> struct({kind} AS kind, e - z.len AS s, e AS e, z.value AS value, z.at AS at)) AS {_SPAN})"
    return _let(zipped, "zs", spans)


def _outside(tokens: str) -> str:
    """SQL: the tokens that share no character with a base span: in order of their starts, none before reaches into one and none after starts within it."""
    marks = f"array_sort(concat(transform({tokens}, (t, i) -> struct(t.s AS s, 1 AS kind, t.e AS e, i AS i)), transform(base, x -> struct(x.s AS s, 0 AS kind, x.e AS e, -1 AS i))))"
    before = _running("transform(ms, m -> IF(m.kind = 0, m.e, -1))", "greatest(x, y)")
    after = f"reverse({_running('reverse(transform(ms, m -> IF(m.kind = 0, m.s, 2147483647)))', 'least(x, y)')})"
    free = f"transform(filter(zip_with(zip_with(ms, {before}, (m, e) -> struct(m, e)), {after}, (x, s) -> struct(x.m AS m, x.e AS e, s AS s)), x -> x.m.kind = 1 AND x.e <= x.m.s AND x.s >= x.m.e), x -> x.m.i)"
    return f"CASE WHEN size(base) = 0 THEN {tokens} ELSE transform({_let(marks, 'ms', free)}, i -> {tokens}[i]) END"


def base_spans(reach: int = Params.reach) -> Column:
    """Spans of the base rules in column ``text``, by kind and start."""
    each = []
    for k, kind in enumerate(KINDS):
        found = f"filter({_matches(_RULES[kind], k, reach)}, x -> {_VALID[kind]})"
        each.append(f"CASE WHEN {_GATES[kind]} THEN {found} ELSE cast(array() AS {_SPAN}) END")
    return F.expr(f"concat({', '.join(each)})")


def _scanned(docs: DataFrame, p: Params, id_col: str, text_col: str) -> DataFrame:
    """``id, mark, base, tokens`` of each row: base spans and identifier-like tokens outside them, from one pass over the texts."""
    rows = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("base", base_spans(p.reach))
    found = f"CASE WHEN text rlike '[0-9@]' THEN {_matches(_TOKEN, -1, p.reach)} ELSE cast(array() AS {_SPAN}) END"
    # signs around a token are not of it; the text beside a token ends at the next token, so patterns never span two
    lead = "length(regexp_extract(t.value, '^[^A-Za-z0-9]*', 0))"
    core = "regexp_extract(t.value, '[A-Za-z0-9](?:.*[A-Za-z0-9])?', 0)"
    cores = f"transform({found}, t -> struct(t.kind AS kind, t.s + {lead} AS s, t.s + {lead} + length({core}) AS e, {core} AS value, t.at AS at))"
    outside = _let(f"filter({cores}, t -> size(t.at) > 0 AND length(t.value) >= 5)", "ts", _outside("ts"))
    seeded = f"transform({outside}, t -> struct(CASE WHEN {_SECRET} THEN {len(KINDS)} ELSE -1 END AS kind, t.s AS s, t.e AS e, t.value AS value, t.at AS at))"
    return rows.select("id", _mark(F.col("id"), F.col("text")), "base", F.expr(seeded).alias("tokens"))


def _mark(id_: Column, text: Column) -> Column:
    """128 bits of a row's id and text."""
    return F.struct(F.xxhash64(id_, text).alias("a"), F.xxhash64(text, id_, F.lit(1)).alias("b")).alias("mark")


def learned_spans(scanned: DataFrame, p: Params) -> DataFrame:
    """``mark, more`` (kind, s, e, whether a seed rule names it too) of the entities that accepted patterns name."""
    beside = lambda c: scanned.select("mark", F.explode(c).alias("x")).select("mark", "x.*").select("mark", "kind", "s", "e", "value", F.explode("at").alias("pattern"))
    tokens = beside("tokens")
    # distinct values of a pattern first: a hot pattern or value is one row from each task
    graph = materialize(beside("base").unionByName(tokens).groupBy("pattern", "value").agg(F.max("kind").alias("kind")), "pii-graph")
    total = graph.groupBy("pattern").agg(F.count(F.lit(1)).alias("total"))
    seeds = graph.where("kind >= 0").select("value", "kind").distinct().withColumn("belief", F.lit(1.0))
    believed, fit, accepted = seeds, None, -1
    for _ in range(p.generations):
        linked = graph.select("pattern", "value").join(believed, "value")
        sums = linked.groupBy("pattern", "kind").agg(F.sum("belief").alias("sum"), F.count(F.lit(1)).alias("support")).where(F.col("support") >= p.support)
        scored = sums.join(total, "pattern").withColumn("confidence", F.col("sum") / (F.col("total") + 1))
        fit = materialize(scored.where(F.col("confidence") >= p.confidence).select("pattern", "kind", "confidence"), "pii-patterns")
        now = fit.count()
        if now == accepted or not now:
            break
        accepted = now
        # belief: one minus the chance that all accepted patterns of the value err
        chance = 1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-9)))))
        grown = graph.where("kind < 0").select("pattern", "value").join(fit, "pattern").groupBy("value", "kind").agg(chance.alias("belief")).where(F.col("belief") >= p.belief)
        believed = materialize(seeds.unionByName(grown), "pii-believed")
    sure = believed.select("value", "kind").distinct()
    named = tokens.withColumn("seed", F.col("kind") >= 0).drop("kind").join(fit.select("pattern", "kind"), "pattern").join(sure, ["value", "kind"], "left_semi")
    return named.groupBy("mark").agg(F.collect_set(F.struct("kind", "s", "e", "seed")).alias("more"))


_PLAIN = "array<struct<kind:int,s:int,e:int>>"


def _joined(spans: str) -> Column:
    names = ", ".join(f"'{k}'" for k in LEARNED)
    return F.expr(f"array_join(transform({spans}, x -> concat_ws(':', element_at(array({names}), x.kind + 1), cast(x.s AS string), cast(x.e AS string))), ',')")


def _plain() -> Column:
    return F.expr(f"cast(transform(base, x -> struct(x.kind, x.s, x.e)) AS {_PLAIN})")


def _with_learned(rows: DataFrame, more: DataFrame) -> DataFrame:
    """``rows`` with ``spans``, base and learned ones by kind and start, and ``more``, the learned ones, which never meet base ones."""
    none = F.expr("cast(array() AS array<struct<kind:int,s:int,e:int,seed:boolean>>)")
    if more.isEmpty():
        return rows.withColumn("spans", _plain()).withColumn("more", none)
    joined = rows.join(more, "mark", "left").withColumn("more", F.coalesce("more", none))
    return joined.withColumn("spans", F.array_sort(F.concat(_plain(), F.expr(f"cast(transform(more, x -> struct(x.kind, x.s, x.e)) AS {_PLAIN})"))))


def find(docs: DataFrame, params: Params = Params(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Personal data in every whole text.

    Returns ``id, n_email, n_ip, n_card, n_phone long`` (base spans),
    ``base_sha256 string``, ``spans string`` (base and learned), ``n_learned,
    n_discovered, n_spans long`` (learned ones, and those among them that no
    rule, seeds included, names), one row per input row.  Null or empty text has none.  A null id stays null; repeated
    rows stay repeated.  Other columns are not read.  Texts are read once; only
    spans are kept and shuffled.
    """
    scanned = materialize(_scanned(docs, params, id_col, text_col), "pii-spans")
    more = materialize(learned_spans(scanned, params), "pii-learned")
    out = _with_learned(scanned, more)
    counts = [F.expr(f"cast(size(filter(base, x -> x.kind = {k})) AS bigint)").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return out.select(F.col("id").alias(id_col), *counts, F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"), F.size("more").cast("bigint").alias("n_learned"), F.expr("cast(size(filter(more, x -> NOT x.seed)) AS bigint)").alias("n_discovered"), F.size("spans").cast("bigint").alias("n_spans"))


def redact(docs: DataFrame, params: Params = Params(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every found span of the text replaced by its kind in brackets; same columns.

    Of overlapping spans the one that starts first names the replacement and
    both go.  Null text stays null.
    """
    scanned = materialize(_scanned(docs, params, id_col, text_col), "pii-spans")
    more = materialize(learned_spans(scanned, params), "pii-learned")
    names = ", ".join(f"'[{k.upper()}]'" for k in LEARNED)
    names_ = docs.columns
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    inner = docs.select(F.struct(*[docs[c] for c in names_]).alias("row"), _mark(docs[id_col], text), text.alias("text")).withColumn("base", base_spans(params.reach))
    own = _with_learned(inner, more).withColumn("spans", F.expr("array_sort(spans, (x, y) -> CASE WHEN x.s <> y.s THEN x.s - y.s ELSE y.e - x.e END)"))
    clean = f"""CASE WHEN size(spans) = 0 THEN text ELSE aggregate(spans, struct(0 AS pos, '' AS out), (a, x) -> CASE WHEN x.s < a.pos
        THEN struct(greatest(a.pos, x.e) AS pos, a.out AS out)
        ELSE struct(x.e AS pos, concat(a.out, substring(text, a.pos + 1, x.s - a.pos), element_at(array({names}), x.kind + 1)) AS out) END,
        a -> concat(a.out, substring(text, a.pos + 1))) END"""
    new = F.when(F.col("row")[text_col].isNull(), F.lit(None)).otherwise(F.expr(clean))
    return own.select(*[new.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in names_])
