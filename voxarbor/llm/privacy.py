"""Personal data by proposed spans and gradient-boosted trees, in DataFrame functions only.

Base rules find what passes a strict pattern and check. Loose generators
propose more; each proposal is described by small numbers of its format and
context. Trees learn, from counts of these descriptions over all documents,
which proposals look like a base match; what the base rules themselves test
(``@``, ``+``, check digits, byte range) is left out of the description, so a
proposal that misses the rule by a typo or an evasion can still look the part.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
LOCAL = "[A-Za-z0-9._%+-]"
# The base patterns, written without backtracking: a match can only begin at the start of a run or where the last
# one ended, and runs are possessive because what follows them is not part of them.
BASE = {
    "email": rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": rf"(?<!{LOCAL}){LOCAL}++(?:@|\x20?(?:\(at\)|\[at\]|\x20at\x20)\x20?)[A-Za-z0-9-]++"
             r"(?:(?:\.|\x20?(?:\(dot\)|\[dot\]|\x20dot\x20)\x20?)[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Za-z.])[0-9]{1,4}+(?:\.[0-9]{1,4}+){3}+(?![0-9A-Za-z]|\.[0-9])",
    "card": r"(?<![0-9A-Za-z])[0-9](?:[\x20./-]?[0-9]){11,18}+(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z+])[(+]{0,2}+[0-9](?:[\x20().-]{0,3}+[0-9]){6,14}+(?![0-9A-Za-z])",
}
HINT = {"email": r"@|(?:\(at\)|\[at\]|\x20at\x20)", "ip": r"[0-9]\.[0-9]", "card": "[0-9]", "phone": "[0-9]"}
FILLER = "\ue000"
CUE = r"(?i)(?:mail|contact|tel|phone|call|fax|mobile|card|visa|account|ip|addr|address|host|server)\W*$"
# Sizes of the description's parts; their product bounds the rows that reach the driver.
RADIX = (("kind", 4), ("digits", 8), ("length", 8), ("marks", 8), ("round", 2), ("letters", 2), ("before", 4),
         ("after", 4), ("cue", 2))


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]+", "")


def luhn(digits: Column) -> Column:
    """Check-digit sum of a digit string is a multiple of ten."""
    def step(c, i):
        d = c.cast("int")
        twice = 2 * d
        return F.when(i % 2 == 0, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), step), F.lit(0),
                       lambda total, d: total + F.coalesce(d, F.lit(0))) % 10 == 0


def passes(kind: str, value: Column) -> Column:
    """Whether a base match of a kind also meets its check."""
    if kind == "ip":
        small = lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(p.cast("int"), F.lit(256)) <= 255)
        return F.forall(F.split(value, r"\.", -1), lambda p: F.when(
            F.length(F.ltrim(p, F.lit("0"))) == 0, True).otherwise(small(F.ltrim(p, F.lit("0")))))
    if kind == "card":
        digits = digits_of(value)
        return F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits_of(value)).between(9, 15)
    return F.lit(True)


def running(values: Column, block: int = 128) -> Column:
    """Exclusive running sums of an int array, in blocks so that long arrays stay cheap."""
    def prefix(part, start):
        sums = F.aggregate(part, F.array(start), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
        return F.slice(sums, 1, F.size(part))

    none = F.array().cast("array<int>")
    parts = F.transform(F.sequence(F.lit(1), F.size(values), F.lit(block)), lambda s: F.slice(values, s, F.lit(block)))
    totals = F.transform(parts, lambda p: F.aggregate(p, F.lit(0), lambda a, x: a + x))
    return F.when(F.size(values) > 0, F.flatten(F.zip_with(parts, prefix(totals, F.lit(0)), prefix))).otherwise(none)


def matched(df: DataFrame, name: str, pattern: str, hint: str, source: str = "text") -> DataFrame:
    """Adds ``<name>_gap`` (text between matches), ``<name>_hit`` (matches) and ``<name>_at`` (their offsets)."""
    worth = F.rlike(source, F.lit(hint))
    df = df.withColumn(f"{name}_hit", F.when(worth, F.regexp_extract_all(source, F.lit(pattern), F.lit(0))).otherwise(
        F.array().cast("array<string>")))
    df = df.withColumn(f"{name}_gap", F.when(F.size(f"{name}_hit") > 0, F.split(source, pattern, -1)))
    steps = F.transform(f"{name}_hit", lambda v, i: F.length(v) + F.length(F.get(f"{name}_gap", i)))
    df = df.withColumn(f"{name}_sum", running(steps))
    return df.withColumn(f"{name}_at", F.transform(
        f"{name}_sum", lambda s, i: s + F.length(F.get(f"{name}_gap", i)))).drop(f"{name}_sum")


def spans_of(kind: str, name: str) -> Column:
    """Passing matches as ``start, rank, end, kind``."""
    every = F.transform(f"{name}_hit", lambda v, i: F.struct(
        F.get(f"{name}_at", i).alias("start"), F.lit(KINDS.index(kind)).alias("rank"),
        (F.get(f"{name}_at", i) + F.length(v)).alias("end"), passes(kind, v).alias("ok")))
    return F.transform(F.filter(every, lambda s: s.ok), lambda s: F.struct(s.start, s.rank, s.end))


def rejoined(name: str, instead) -> Column:
    """The text with each match replaced by ``instead(match)``."""
    parts = F.transform(f"{name}_gap", lambda g, i: F.concat(g, F.when(
        i < F.size(f"{name}_hit"), instead(F.get(f"{name}_hit", i))).otherwise("")))
    return F.array_join(parts, "")


def blank(kind: str):
    """Replaces a passing match by as many fillers; other matches stay."""
    return lambda v: F.when(passes(kind, v), F.repeat(F.lit(FILLER), F.length(v))).otherwise(v)


def described(kind: str, name: str, base: bool) -> Column:
    """Proposals of a kind: offsets, description and, for training, whether the base rule holds for them."""
    def one(v, i):
        gap, later = F.get(f"{name}_gap", i), F.get(f"{name}_gap", i + 1)
        before = F.right(gap, F.lit(24))

        def side(c):
            return F.when(c == "", 0).when(F.rlike(c, F.lit(r"\s")), 1).when(
                F.rlike(c, F.lit(r"[:=,;.\"'()<>\[\]!?]")), 2).otherwise(3)

        n = F.length(digits_of(v))
        bucket = F.when(n < 4, 0).when(n < 7, 1).when(n < 9, 2).when(n < 11, 3).when(n < 12, 4).when(n < 15, 5).when(
            n < 17, 6).otherwise(7)
        facts = {
            "kind": F.lit(KINDS.index(kind)), "digits": bucket,
            "length": F.least(F.floor(F.length(v) / 4), F.lit(7)).cast("int"),
            "marks": F.contains(v, F.lit(" ")).cast("int") + 2 * F.contains(v, F.lit("-")).cast("int")
            + 4 * F.contains(v, F.lit(".")).cast("int"),
            "round": F.contains(v, F.lit("(")).cast("int"), "letters": F.rlike(v, F.lit("[A-Za-z]")).cast("int"),
            "before": side(F.right(gap, F.lit(1))), "after": side(F.left(later, F.lit(1))),
            "cue": F.rlike(before, F.lit(CUE)).cast("int")}
        code = F.lit(0)
        for part, size in RADIX:
            code = code * size + facts[part]
        strict = F.rlike(v, F.lit(f"^(?:{BASE[kind]})$")) & passes(kind, v) if base else F.lit(False)
        return F.struct(F.get(f"{name}_at", i).alias("start"), F.lit(KINDS.index(kind)).alias("rank"),
                        (F.get(f"{name}_at", i) + F.length(v)).alias("end"), code.alias("code"), strict.alias("strict"))

    return F.transform(f"{name}_hit", one)


@dataclass
class Trees:
    """Boosted trees of two levels: ``(part, bound, (part, bound, low, high), (part, bound, low, high))`` and the
    score from which each kind's proposals are selected (None: none)."""

    trees: list = field(default_factory=list)
    limits: dict = field(default_factory=dict)

    def score(self, parts):
        total = 0.0
        for part, bound, low, high in self.trees:
            inner = low if parts[part] <= bound else high
            total += inner[2] if parts[inner[0]] <= inner[1] else inner[3]
        return total

    def sql(self, code: str) -> str:
        """The score as one SQL expression over the name of a description code."""
        at, place = {}, 1
        for part, size in reversed(RADIX):
            at[part] = f"({code} div {place}) % {size}"
            place *= size
        leaf = "CASE WHEN {0} <= {1} THEN {2!r}D ELSE {3!r}D END"
        trees = (f"CASE WHEN {at[part]} <= {bound} THEN {leaf.format(at[low[0]], *low[1:])} "
                 f"ELSE {leaf.format(at[high[0]], *high[1:])} END" for part, bound, low, high in self.trees)
        return " + ".join(trees) or "0D"


def unpacked(code: int) -> dict[str, int]:
    """Parts of a description code."""
    out = {}
    for part, size in reversed(RADIX):
        code, out[part] = divmod(code, size)
    return out


def boost(rows: list[tuple[int, int, int]], rounds: int = 24, rate: float = 0.3, decay: float = 2.0) -> list:
    """Two-level trees for logistic loss on ``(code, positives, all)`` rows."""
    data = [(unpacked(code), float(yes), float(all_)) for code, yes, all_ in rows]
    raw, trees = [0.0] * len(data), []

    def leaf(g, h):
        return rate * g / (h + decay)

    def split(which, stats):
        g_all, h_all = (sum(stats[i][k] for i in which) for k in (0, 1))
        best = (0.0, "kind", RADIX[0][1], leaf(g_all, h_all), 0.0)
        for part, size in RADIX:
            g, h = [0.0] * size, [0.0] * size
            for i in which:
                g[data[i][0][part]] += stats[i][0]
                h[data[i][0][part]] += stats[i][1]
            gl = hl = 0.0
            for bound in range(size - 1):
                gl, hl = gl + g[bound], hl + h[bound]
                gain = gl * gl / (hl + decay) + (g_all - gl) ** 2 / (h_all - hl + decay) - g_all ** 2 / (h_all + decay)
                if gain > best[0] + 1e-9:
                    best = (gain, part, bound, leaf(gl, hl), leaf(g_all - gl, h_all - hl))
        return best[1:]

    for _ in range(rounds):
        stats = []
        for (_, yes, n), score in zip(data, raw):
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, score))))
            stats.append((yes - n * p, n * p * (1 - p)))
        everyone = range(len(data))
        part, bound, _, _ = split(everyone, stats)
        sides = [[i for i in everyone if (data[i][0][part] <= bound) == low] for low in (True, False)]
        trees.append((part, bound, split(sides[0], stats), split(sides[1], stats)))
        one = Trees([trees[-1]])
        raw = [r + one.score(d[0]) for r, d in zip(raw, data)]
    return trees


def learn(docs: DataFrame, key: str = "doc_id", text: str = "text", precision: float = 0.9, least: int = 20) -> Trees:
    """Trees from the proposals in all documents.

    Descriptions are counted with map-side combining; at most as many rows as
    there are descriptions (the product of ``RADIX``) reach the driver.
    A quarter of the documents, by hash of the key, only calibrates: a kind's
    limit is the lowest score whose proposals at or above it are base matches in
    at least the share ``precision``, with ``least`` of them or more. Kinds
    without such a score select nothing, nor does an empty table.
    """
    df = docs.select(F.col(text).alias("text"), (F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(4)) == 0).alias(
        "checks")).where(F.rlike("text", F.lit("[0-9@]|" + HINT["email"])))
    for kind in KINDS:
        df = matched(df, kind, LOOSE[kind], HINT[kind])
    seen = df.select("checks", F.explode(F.concat(*[described(k, k, True) for k in KINDS])).alias("c"))
    counts = seen.groupBy("checks", F.col("c.code").alias("code")).agg(
        F.sum(F.col("c.strict").cast("int")).alias("yes"), F.count("*").alias("n")).collect()
    fitted = [(r["code"], r["yes"], r["n"]) for r in counts if not r["checks"]]
    model = Trees(boost(sorted(fitted)) if fitted else [])
    for rank, kind in enumerate(KINDS):
        scored = sorted(((model.score(p), r["yes"], r["n"]) for r in counts if r["checks"]
                         and (p := unpacked(r["code"]))["kind"] == rank), reverse=True)
        yes = n = 0
        limit = None
        for at, (score, y, k) in enumerate(scored):
            yes, n = yes + y, n + k
            last = at + 1 == len(scored) or scored[at + 1][0] < score
            if last and n >= least and yes >= precision * n:
                limit = score
        model.limits[kind] = limit
    return model


def redact(docs: DataFrame, model: Trees, text: str = "text") -> DataFrame:
    """All rows and columns, with the spans of ``find`` replaced in the text; null texts stay null."""
    rows = docs.select(F.struct("*").alias("row"), F.col(text).alias("text"))
    found = find(rows, model, "row", "text")
    plain = redacted(F.col("text"), F.array_sort(F.concat("base", "added")))
    return found.select(F.col("row").withField(text, F.when(F.col(f"row.{text}").isNotNull(), plain)).alias("row")).select(
        "row.*")


def find(docs: DataFrame, model: Trees, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, text, base, added``: spans of every whole text as arrays of ``start, rank, end`` (code points, end
    exclusive; rank in ``KINDS``), each in order.

    Added spans are proposals in what the base spans leave over, selected by
    the trees. Null and empty texts have no spans; repeated rows are treated
    row by row; other columns are dropped; no row meets another, so there is no
    shuffle.
    """
    df = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    df = df.withColumn("rest", F.col("text"))
    for kind in KINDS:
        df = matched(df, kind, BASE[kind], HINT[kind] if kind != "email" else "@")
        df = df.withColumn(f"{kind}_base", spans_of(kind, kind))
    df = df.withColumn("base", F.array_sort(F.concat(*[F.col(f"{k}_base") for k in KINDS]))).select(
        "key", "text", "rest", "base")
    for kind in KINDS:  # blank out what is found, in place, so that proposals leave it alone
        df = matched(df, kind, BASE[kind], HINT[kind] if kind != "email" else "@", "rest")
        df = df.withColumn("rest", F.when(F.size(f"{kind}_hit") > 0, rejoined(kind, blank(kind))).otherwise(
            F.col("rest"))).drop(f"{kind}_hit", f"{kind}_gap", f"{kind}_at")
    live = [k for k in KINDS if model.limits.get(k) is not None]
    for kind in live:
        df = matched(df, kind, LOOSE[kind], HINT[kind], "rest")
        df = df.withColumn(f"{kind}_new", described(kind, kind, False))
    score = model.sql("c.code")
    added = [F.expr(f"transform(filter({k}_new, c -> {score} >= {model.limits[k] - 1e-9!r}D), "
                    "c -> struct(c.`start` AS `start`, c.`rank` AS `rank`, c.`end` AS `end`))") for k in live]
    none = F.array().cast("array<struct<start:int,rank:int,end:int>>")
    return df.select("key", "text", "base", (F.array_sort(F.concat(*added)) if added else none).alias("added")).withColumnRenamed(
        "key", key)


def ranked(rank: int):
    """Test for spans of one kind."""
    return lambda s: s.rank == rank


def listed(spans: Column) -> Column:
    """``kind:start:end`` of the spans, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s.rank + 1), s.start.cast("string"), s.end.cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; overlapping spans share the first one's mark."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    done = F.aggregate(F.array_sort(spans), F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")),
                       lambda acc, s: F.struct(
        F.greatest(acc.at, s.end).alias("at"),
        F.when(s.start < acc.at, acc.out).otherwise(F.concat(acc.out, F.array(
            F.substring(text, acc.at + 1, s.start - acc.at), F.element_at(names, s.rank + 1)))).alias("out")))
    # the rest after the last span
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(F.array_join(done.out, ""), F.substring(
        text, done.at + 1, F.length(text))))
