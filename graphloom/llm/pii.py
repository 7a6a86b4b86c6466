"""Personal data by candidate gradient boosting, in DataFrame functions only.

High-recall generators propose spans that may overlap (also inside matches that the base rules drop, as where
a phone number runs into a card number, and spelled-out addresses). Boosted trees of depth two use format
and context features of each candidate; thresholds a kind, calibrated on held-out folds, select. The base rules' spans
always stay; a selected candidate joins them unless it overlaps one.

The trees are fitted on the driver from counts of feature vectors (small integers, so their number is
bounded by their ranges, not by the input): candidates of the whole corpus that coincide with a base
span count as positive, those that fail a check digit or stand behind a word for another kind of number
(and none for theirs) as negative, and a fixed set of labelled phrases (``seeds``) adds both. Thresholds are
calibrated on folds of documents held out of the fit. The trees score as one nested SQL expression. A row's
spans are worked out within the row, in time linear in its matches (``_scan``); nothing is shuffled but the
counts.

Positions are code points, the end exclusive. Base patterns are written with possessive quantifiers and
look-behinds that match the same spans without deep recursion or rescans of long runs.

Defined cases: null text has no spans and the digest of the empty string; repeated rows get equal results; an
empty table gives an empty result; other columns are ignored by ``spans`` and kept by ``redact``.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, table

KINDS = ("email", "ip", "card", "phone")
_LOCAL, _HOST, _OCTET = "A-Za-z0-9._%+-", "[A-Za-z0-9-]", "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: Leftmost non-overlapping matches of the base patterns; \G lets a match begin right after the one before.
BASE = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@{_HOST}++(?:\.{_HOST}++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # a greedy run of digits with single separators is taken whole or not at all; only runs of 16 to 19 digits count
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Generators: wider than the base, several a kind.
WIDE = {
    "email": [rf"(?<![{_LOCAL}])[{_LOCAL}]++(?:\x20?[(\[{{<]\x20?(?:at|AT|@)\x20?[)\]}}>]\x20?|\x20(?:at|AT)\x20){_HOST}++(?:(?:\x20?[(\[{{<]\x20?(?:dot|DOT|\.)\x20?[)\]}}>]\x20?|\x20(?:dot|DOT)\x20|\.){_HOST}{{2,}}+)++"],
    "ip": [rf"(?<![0-9])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9])", r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"],
    "card": [r"(?<![0-9])[0-9]{4}[\x20-]?[0-9]{4}[\x20-]?[0-9]{4}[\x20-]?[0-9]{4}(?![0-9])", r"(?<![0-9])3[47][0-9]{2}[\x20-]?[0-9]{6}[\x20-]?[0-9]{5}(?![0-9])"],
    "phone": [r"(?<![0-9+])(?:\+|00)[0-9]{1,3}[\x20.-]?\(?[0-9]{2,4}\)?[\x20.-]?[0-9]{3,4}[\x20.-]?[0-9]{3,4}(?![0-9])", r"(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])"],
}
GOOD = r"(?:mail|e-mail|contact|write to|reach|tel|phone|call|mobile|cell|fax|dial|text|card|visa|master|amex|credit|debit|pay|ip|host|server|address|login|from|client)[\x20:.=#,]*(?:me|us|is|at|no|number)?[\x20:.=#,(]*$"
BAD = r"(?:version|ver|v|release|build|order|invoice|ticket|ref|isbn|issn|sku|serial|part|section|chapter|id|doi|model|tracking|page|look|meet|\$|€)[\x20:.=#,]*(?:no|number)?[\x20:.=#,(]*$"
FEATURES = ("kind", "digits", "luhn", "plus", "paren", "separators", "before", "after", "good", "bad", "bracketed", "lead", "flat", "pattern")


_SPAN = "array<struct<start:int,end:int,s:string,pre:string,post:string>>"
_BLOCK, _CHUNK, FOLDS = 200, 256, 4


def _let(name: str, value: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def _scan(array: str, init: str, step: str, emit: str, kind: str) -> str:
    """SQL: what ``emit`` gives for each element x, with the state b.s before it; ``step`` gives the state after it.

    Elements are taken in blocks, each with an array of its own: appending to one array would copy it for every element.
    """
    inner = f"aggregate(blk, named_struct('s', a.s, 'out', cast(array() as array<{kind}>)), (b, x) -> named_struct('s', {step}, 'out', array_append(b.out, {emit})))"
    outer = f"aggregate(transform(sequence(0, (size(arr) - 1) div {_BLOCK}), i -> slice(arr, i * {_BLOCK} + 1, {_BLOCK})), named_struct('s', {init}, 'out', cast(array() as array<array<{kind}>>)), (a, blk) -> {_let('r', inner, 'named_struct(' + chr(39) + 's' + chr(39) + ', r.s, ' + chr(39) + 'out' + chr(39) + ', array_append(a.out, r.out))')}, a -> flatten(a.out))"
    return _let("arr", array, f"if(size(arr) = 0, cast(array() as array<{kind}>), {outer})")


def _located(rx: str, gate: str, text: str = "txt") -> str:
    """SQL: array of structs (start, end, ...) of a pattern's matches, from the matches and the pieces between them.

    The gate is a cheap condition that holds wherever the pattern can match; pieces are cut only where there are matches.
    """
    ends = _scan("w", "0", "b.s + x.gap + x.len", "b.s + x.gap + x.len", "int")
    spans = f"zip_with(w, {ends}, (x, e) -> named_struct('start', e - x.len, 'end', e, 's', x.s, 'pre', x.pre, 'post', x.post))"
    met = "transform(m, (y, i) -> named_struct('gap', length(p[i]), 'len', length(y), 's', y, 'pre', right(p[i], 24), 'post', left(p[i + 1], 2)))"
    cut = _let("p", f"split({text}, r'{rx}', -1)", _let("w", met, spans))
    none = f"cast(array() as {_SPAN})"
    return f"if({gate}, {_let('m', f'regexp_extract_all({text}, r{chr(39)}{rx}{chr(39)}, 0)', f'if(size(m) = 0, {none}, {cut})')}, {none})"


def _luhn(d: str) -> str:
    """SQL: whether a string of digits passes the check-digit rule."""
    v = f"cast(substr({d}, -j, 1) as int)"
    return f"aggregate(sequence(1, greatest(length({d}), 1)), 0, (t, j) -> t + if(j % 2 = 0, 2 * {v} - if({v} > 4, 9, 0), {v})) % 10 = 0"


_DIGITS = "regexp_replace(c.s, '[^0-9]', '')"
_VALID = {
    "email": "true",
    "ip": "forall(split(c.s, r'\\.'), o -> o rlike r'^0*(?:[0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$')",
    "card": _luhn(_DIGITS),
    "phone": f"length({_DIGITS}) between 8 and 15",
}
_QUAD = r"txt rlike r'[0-9]\.[0-9]+\.[0-9]'"
_GATE = {"email": "contains(txt, '@')", "ip": _QUAD, "card": r"txt rlike r'[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]'", "phone": "contains(txt, '+')"}
_WIDE_GATE = {
    "email": [r"txt rlike r'[(\[{<]\x20?(?:at|AT|@)\x20?[)\]}>]|\x20(?:at|AT)\x20[A-Za-z0-9-]+(?:\.|\x20?[(\[{<]|\x20(?:dot|DOT)\x20)'"],
    "ip": [_QUAD, "contains(txt, ':') and txt rlike r'[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:[0-9A-Fa-f]{1,4}:'"],
    "card": [r"txt rlike r'[0-9]{4}[\x20-]?[0-9]{4}'", r"txt rlike r'3[47][0-9]{2}[\x20-]?[0-9]{6}'"],
    "phone": [r"(contains(txt, '+') or contains(txt, '00')) and txt rlike r'(?:\+|00)[0-9]'", r"txt rlike r'[0-9]{3}[\x20.-][0-9]{4}'"],
}


def _class(ch: str) -> str:
    return f"case when {ch} = '' or {ch} rlike r'^\\s' then 0 when {ch} rlike '^[A-Za-z]' then 1 when {ch} rlike '^[0-9]' then 2 else 3 end"


def _features(kind: int, pattern: int) -> str:
    d = _DIGITS
    each = {
        "kind": str(kind), "digits": f"least(length({d}), 20)", "luhn": f"if(length({d}) between 13 and 19, cast({_luhn(d)} as int), 0)",
        "plus": "cast(startswith(c.s, '+') as int)", "paren": "cast(contains(c.s, '(') as int)",
        "separators": "size(array_distinct(filter(split(regexp_replace(c.s, '[0-9A-Za-z]+', ''), ''), q -> q <> '')))",
        "before": _class("right(c.pre, 1)"), "after": _class("c.post"),
        "good": f"cast(lower(c.pre) rlike r'{GOOD}' as int)", "bad": f"cast(lower(c.pre) rlike r'{BAD}' as int)",
        "bracketed": r"cast(c.s rlike r'[(\[{<]\x20?(?:at|AT|dot|DOT|@|\.)\x20?[)\]}>]' as int) + cast(c.s rlike r'(?i:\x20dot\x20|[(\[{<]\x20?dot)' as int)",
        "lead": f"cast(left({d}, 1) in ('3', '4', '5', '6') as int)", "flat": f"cast(size(array_distinct(split({d}, ''))) <= 3 as int)", "pattern": str(pattern),
    }
    return ", ".join(f"'{k}', {each[k]}" for k in FEATURES)


def located(docs: DataFrame) -> DataFrame:
    """Adds base (array of kind, start, end), cands (array of start, end, features) and fold (of the text) to a frame with a column txt."""
    base, cands = [], []
    for k, kind in enumerate(KINDS):
        base.append(f"transform(filter({_located(BASE[kind], _GATE[kind])}, c -> {_VALID[kind]}), c -> named_struct('kind', {k}, 'start', c.start, 'end', c.end))")
        for n, (rx, gate) in enumerate(zip(WIDE[kind], _WIDE_GATE[kind], strict=True)):
            cands.append(f"transform({_located(rx, gate)}, c -> named_struct('start', c.start, 'end', c.end, {_features(k, n)}))")
    fold = F.pmod(F.xxhash64("txt"), F.lit(FOLDS)).cast("int")
    return docs.withColumn("base", F.expr(f"concat({', '.join(base)})")).withColumn("cands", F.expr(f"concat({', '.join(cands)})")).withColumn("fold", fold)


def seeds() -> list[tuple[str, int]]:
    """Labelled phrases, by rule: (text with one kind of candidate, 1 if it is personal data)."""
    out = []
    luhn = lambda s: s + str((10 - sum((2 * int(c) - 9 * (int(c) > 4)) if i % 2 == 0 else int(c) for i, c in enumerate(reversed(s)))) % 10)
    say = ["{}", "and {} the", "tel {}", "call {}", "reach me at {}", "ref, {}.", "word {} word", "contact: {}", "the end. {}\n"]
    not_ = ["order {}", "invoice no {}", "ref {}", "serial {}", "tracking number {}", "isbn {}", "id {}", "sku: {}", "part {}"]
    for i in range(9):
        cards = [luhn(f"{3 + i % 4}{(7919 * (i + 3)) % 10**7:07d}{(104729 * (i + 5)) % 10**7:07d}")]
        cards += [f"{c[:4]} {c[4:8]} {c[8:12]} {c[12:]}" for c in cards]
        for c in cards:
            out += [(say[j].format(c), 1) for j in (0, 1, i % 9)] + [(f"+{44 + i} ({310 + i}) 555-{1207 + 83 * i} {c}", 1)]
            broken = c[:-1] + str((int(c[-1]) + 1 + i) % 10 if (1 + i) % 10 else (int(c[-1]) + 5) % 10)
            out += [(s.format(broken), 0) for s in (not_[i], say[1], say[6])]
            if len(c) == 16:
                out += [(f"{x}{c}{y}", 0) for x, y in (("a", "b"), ("x", ""))]
        phones = [f"+{1 + i} ({212 + i}) 555-{1000 + 37 * i}", f"+1 {415 + i}-555-{2000 + 41 * i}", f"+{40 + i} {20 + i} {5550 + i} {3000 + i}", f"({300 + i}) 555-{4000 + i}"]
        out += [(say[j].format(p), 1) for p in phones for j in (1, i)]
        out += [(s.format(f"{200 + i}-555-{4000 + i}"), 1) for s in ("call {}", "phone: {}", "tel. {}", "mobile {}")]
        out += [(not_[i].format(f"{200 + i}.{300 + i}.{4000 + i}"), 0), (not_[i].format(f"{200 + i}-{300 + i}-{4000 + i}"), 0), (f"x{100 + i}-200-{3000 + i}y", 0), (f"the {500 + i} {600 + i} {7000 + i} of", 0)]
        out += [(s.format(f"{10 + i}.{20 + i}.{30 + i}.{40 + i}"), 1) for s in ("{}", "and {} the", "host {}", "server: {}", "from {}", "end. {}")]
        out += [(s.format(f"{1 + i}.{2 + i}.{i}.{4 + i}"), 0) for s in ("version {}", "v{}", "section {}", "release {}", "build {}", "9.{}", "{}.7")]
        out += [(f"host 2001:db8:0:{i}:0:0:{i}:1", 1), (f"and 2001:db8:85a3:{i}:0:8a2e:370:7334 the", 1)]
        at = [("(at)", "(dot)"), ("[at]", "[dot]"), (" (at) ", "."), (" [at] ", " [dot] "), (" at ", " dot ")]
        out += [(s.format(f"jo.{i}{a}mail{d}example{d}com"), 1) for a, d in at for s in ("{}", "write to {}", "and {} the")]
        out += [(f"look at page{i}.Then", 0), (f"we met at home{i}.It was", 0), (f"arrived at noon.At {i}", 0), (f"sold at {i}.50 each", 0), (f"and at the{i}.end", 0)]
    return out


class Trees:
    """Boosted trees of depth two over small integers, for log-odds."""

    def __init__(self, start: float, trees: list):
        self.start, self.trees = start, trees

    def value(self, x) -> float:
        return self.start + sum((a[2] if x[a[0]] <= a[1] else a[3]) if x[f] <= c else (b[2] if x[b[0]] <= b[1] else b[3]) for f, c, a, b in self.trees)

    def sql(self) -> str:
        leaf = lambda t: f"if(c.{FEATURES[t[0]]} <= {t[1]}, {t[2]!r}D, {t[3]!r}D)"
        return " + ".join([f"{self.start!r}D", *(f"if(c.{FEATURES[f]} <= {c}, {leaf(a)}, {leaf(b)})" for f, c, a, b in self.trees)])


def boost(rows: list[tuple[tuple[int, ...], int, float]], rounds: int = 24, rate: float = 0.4, lam: float = 1.0) -> Trees:
    """Second-order boosting for the logistic loss on weighted feature vectors."""
    x = np.array([r[0] for r in rows], np.int64).reshape(len(rows), len(FEATURES))
    y, w = np.array([r[1] for r in rows], float), np.array([r[2] for r in rows], float)
    start = round(math.log((w @ y + 1) / (w @ (1 - y) + 1)), 6)
    score, trees = np.full(len(rows), start), []
    cuts = [(f, int(c)) for f in range(len(FEATURES)) for c in np.unique(x[:, f])[:-1]]
    low = np.array([x[:, f] <= c for f, c in cuts], float).reshape(len(cuts), len(rows))
    leaf = lambda g, h: round(float(-rate * g / (h + lam)), 6)

    def split(mine, g, h):
        g, h = g * mine, h * mine
        G, H = g.sum(), h.sum()
        if not cuts:
            return 0, 0, leaf(G, H), leaf(G, H)
        gl, hl = low @ g, low @ h
        k = int(np.argmax(np.round(gl * gl / (hl + lam) + (G - gl) ** 2 / (H - hl + lam), 9)))  # the first of equals
        return *cuts[k], leaf(gl[k], hl[k]), leaf(G - gl[k], H - hl[k])

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = w * (p - y), np.maximum(w * p * (1 - p), 1e-9)
        f, c, *_ = split(np.ones(len(rows)), g, h)
        first = x[:, f] <= c
        a, b = split(first.astype(float), g, h), split((~first).astype(float), g, h)
        trees.append((f, c, a, b))
        score = score + np.where(first, np.where(x[:, a[0]] <= a[1], a[2], a[3]), np.where(x[:, b[0]] <= b[1], b[2], b[3]))
    return Trees(start, trees)


def held_out(rows: list) -> list[tuple[int, float, int, float]]:
    """(kind, log-odds, label, weight) of every labelled vector by trees that were fitted without its fold. rows: (vector, label, weight, fold)."""
    out = []
    for k in range(FOLDS):
        t = boost([r[:3] for r in rows if r[3] != k])
        out += [(x[0], t.value(x), y, w) for x, y, w, f in rows if f == k]
    return out


def calibrate(scored: list, precision: float = 0.97) -> list[float]:
    """Log-odds threshold a kind: the lowest that keeps the precision on held-out folds, 0 at least."""
    out = []
    for kind in range(len(KINDS)):
        own = sorted((s for s in scored if s[0] == kind), key=lambda s: -s[1])
        hit = total = 0.0
        best = 0.0 if not own else own[0][1]
        for _, s, y, w in own:
            hit, total = hit + w * y, total + w
            if hit / total >= precision:
                best = s
        out.append(round(max(0.0, best - 1e-6), 6))
    return out


def labelled(found: DataFrame) -> list[tuple[tuple[int, ...], int, float, int]]:
    """(vector, label, weight, fold) from the corpus' candidates and the seeds. found: the result of ``located``."""
    spark = found.sparkSession
    fields = "struct<start:int,end:int," + ",".join(f"{x}:int" for x in FEATURES) + ">"
    key = lambda x: f"'kind', {x}.kind, 'start', {x}.start, 'end', {x}.end"
    # a base span sorts right before the candidates that coincide with it
    every = f"array_sort(concat(transform(base, c -> named_struct({key('c')}, 'rank', 0, 'c', cast(null as {fields}))), transform(cands, c -> named_struct({key('c')}, 'rank', 1, 'c', c))))"
    told = _scan(every, "named_struct('kind', -1, 'start', -1, 'end', -1)", f"if(x.rank = 0, named_struct({key('x')}), b.s)", f"named_struct('same', b.s = named_struct({key('x')}), 'c', x.c)", f"struct<same:boolean,c:{fields}>")
    c = found.where("size(cands) > 0").select("fold", F.explode(F.expr(told)).alias("x")).where("x.c is not null").select("fold", "x.same", "x.c")
    same = F.col("same")
    other = ((F.col("c.kind") == KINDS.index("card")) & (F.col("c.luhn") == 0)) | ((F.col("c.bad") == 1) & (F.col("c.good") == 0))
    c = c.withColumn("y", F.when(same, 1).when(other, 0)).where("y is not null")
    # at most as many rows as there are feature vectors, whatever the corpus
    counted = c.groupBy(*[F.col(f"c.{x}").alias(x) for x in FEATURES], "y", "fold").count().collect()
    rows = [(tuple(int(r[x]) for x in FEATURES), r.y, 1 + math.log(r["count"]), r.fold) for r in counted]
    quote = lambda s: s.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n")
    values = ", ".join(f"({i}, '{quote(s)}', {y})" for i, (s, y) in enumerate(seeds()))
    seeded = located(spark.sql(f"SELECT * FROM VALUES {values} AS t(i, txt, y)")).select("y", "fold", F.explode("cands").alias("c"))
    for r in seeded.collect():
        rows.append((tuple(int(r.c[x]) for x in FEATURES), r.y, 1.0, r.fold))
    merged: dict = {}
    for x, y, w, f in rows:
        merged[(x, y, f)] = merged.get((x, y, f), 0.0) + w
    return [(x, y, w, f) for (x, y, f), w in sorted(merged.items())]


def fit(found: DataFrame) -> tuple[Trees, list[float]]:
    """Trees and thresholds from the corpus' feature-vector counts and the seeds. found: the result of ``located``."""
    rows = labelled(found)
    return boost([r[:3] for r in rows]), calibrate(held_out(rows))


def selected(found: DataFrame, model: tuple[Trees, list[float]]) -> DataFrame:
    """Replaces cands by spans: base spans and selected candidates that overlap no base span nor an earlier pick, by kind and start."""
    trees, at = model
    limit = f"element_at(array({', '.join(f'{t!r}D' for t in at)}), c.kind + 1)"
    kind = "struct<start:int,stop:int,kind:int,own:boolean,hit:boolean>"
    as_ = lambda x, own: f"named_struct('start', {x}.start, 'stop', -{x}.end, 'kind', {x}.kind, 'own', {own}, 'hit', false)"
    picks = f"transform(filter(cands, c -> ({trees.sql()}) >= {limit}), c -> {as_('c', 'false')})"
    # one pass forward finds the base spans that begin before a candidate and reach into it, one pass back those that begin inside it
    every = f"array_sort(concat(picks, transform(base, c -> {as_('c', 'true')})))"
    marked = lambda hit: f"named_struct('start', x.start, 'stop', x.stop, 'kind', x.kind, 'own', x.own, 'hit', x.hit or {hit})"
    ahead = _scan(every, "0", "if(x.own, greatest(b.s, -x.stop), b.s)", marked("b.s > x.start"), kind)
    back = _scan(f"reverse({ahead})", "2147483647", "if(x.own, x.start, b.s)", marked("b.s < -x.stop"), kind)
    free = f"filter(reverse({back}), x -> not x.own and not x.hit)"
    taken = _scan(free, "0", "if(x.start >= b.s, -x.stop, b.s)", "named_struct('kind', if(x.start >= b.s, x.kind, -1), 'start', x.start, 'end', -x.stop)", "struct<kind:int,start:int,end:int>")
    spans = _let("picks", picks, f"if(size(picks) = 0, array_sort(base), array_sort(concat(base, filter({taken}, x -> x.kind >= 0))))")
    return found.withColumn("spans", F.expr(spans)).drop("cands", "fold")


_NAMED = "element_at(array(" + ", ".join(f"'{k}'" for k in KINDS) + "), s.kind + 1)"


def _text(col: str) -> F.Column:
    return F.expr(f"array_join(transform(array_sort({col}), s -> concat({_NAMED}, ':', s.start, ':', s.end)), ',')")


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, spans) a row: arrays of (kind, start, end)."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("txt"))
    found = keep(located(d).drop("txt"))
    return selected(found, fit(found))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The input rows with every span of their text replaced by its kind in angle brackets."""
    names = docs.columns
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(f"`{text_col}`").alias("txt"))
    found = located(d.select("txt").where("txt is not null"))
    model = fit(keep(found.select("base", "cands", "fold").where("size(cands) > 0")))
    done = selected(located(d.withColumn("txt", F.coalesce("txt", F.lit("")))), model)
    # spans by place; where kinds overlap, the earlier and longer one names the stretch, which goes on to the end of the later one
    order = "array_sort(transform(spans, s -> named_struct('start', s.start, 'stop', -s.end, 'kind', s.kind)))"
    runs = _scan(order, "0", "greatest(b.s, -x.stop)", "named_struct('start', x.start, 'kind', x.kind, 'new', x.start >= b.s, 'reach', greatest(b.s, -x.stop))", "struct<start:int,kind:int,new:boolean,reach:int>")
    ends = "filter(runs, (x, i) -> i = size(runs) - 1 or runs[i + 1].new)"
    stretches = f"zip_with(filter(runs, x -> x.new), {ends}, (s, e) -> named_struct('start', s.start, 'end', e.reach, 'kind', s.kind))"
    # the text in chunks, so that no piece is sought from its beginning
    piece = lambda a, b: f"if({b} <= {a}, '', substr(array_join(slice(chunks, {a} div {_CHUNK} + 1, ({b} - 1) div {_CHUNK} - {a} div {_CHUNK} + 1), ''), {a} % {_CHUNK} + 1, {b} - {a}))"
    before = "if(i = 0, 0, cut[i - 1].end)"
    parts = f"transform(cut, (s, i) -> concat({piece(before, 's.start')}, '<', {_NAMED}, '>'))"
    rest = piece("element_at(cut, -1).end", "length(txt)")
    joined = _let("chunks", f"regexp_extract_all(txt, r'(?s).{{1,{_CHUNK}}}', 0)", f"concat(array_join({parts}, ''), {rest})")
    clean = F.expr(f"if(size(spans) = 0, txt, {_let('runs', runs, _let('cut', stretches, joined))})")
    done = done.withColumn("clean", F.when(F.col("row")[text_col].isNull(), F.lit(None)).otherwise(clean))
    return done.select(*[(F.col("clean") if c == text_col else F.col("row")[c]).alias(c) for c in names])


def op5_pii(spark, sf_dir: str) -> DataFrame:
    s = spans(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda b: b["kind"] == k)).cast("long")
    return s.select("doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)], F.sha2(_text("base"), 256).alias("base_sha256"), _text("spans").alias("spans"))
