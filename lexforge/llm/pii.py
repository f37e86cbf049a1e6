"""Personal data by weak supervision, in DataFrame functions alone.

Patterns propose spans, those that fail their rule among them. Labelers for form, rule, gazetteer, context and edges
each say yes, no or nothing. Expectation maximisation over the counts of vote cells (bounded, whatever the corpus)
estimates how often each labeler says yes to real and to other spans, and how common each kind is; its posteriors
train a logistic classifier of votes, kind and shape. Base spans always stand; further proposals stand where
the classifier accepts them. Everything within a text takes time in proportion to its length and spans.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexforge.llm.labelled import apply_logistic, logistic
from lexforge.llm.rows import fresh
from lexforge.session import cut

#: Base kinds in their order, then proposed ones.
BASE = ("email", "ip", "card", "phone")
EXTRA = ("local_phone", "national_id", "spelled_email", "inner_card")
KINDS = BASE + EXTRA
#: Java patterns. Possessive and anchored to the start of a run where that cannot change a match, so
#: that long runs take linear time.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "local_phone": r"(?<![0-9+A-Za-z])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9A-Za-z])",
    "national_id": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "spelled_email": r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{1,64}\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{1,63}(?:\x20?[\[(]dot[\])]\x20?[A-Za-z0-9-]{1,63}){1,4}",
    # A card within a longer run: the first digit is matched, the whole is looked at, so that the next may overlap it.
    "inner_card": r"(?<![0-9])(?=([0-9]{4}[\x20-][0-9]{4}[\x20-][0-9]{4}[\x20-][0-9]{4}(?![0-9])|[0-9]{4}[\x20-][0-9]{6}[\x20-][0-9]{5}(?![0-9])|[0-9]{13,19}(?![0-9])))[0-9]",
}
#: A text without this has no match of the kind.
HINTS = {"email": "@", "phone": "+", "spelled_email": "at"}
#: Digits from which a failing run of digits is worth a vote.
NEAR_CARD = 8

# Gazetteers: fixed values. Top-level domains, card issuers and calling codes by their first digits, addresses that
# belong to nobody, words near personal data and words near other numbers.
DOMAINS = "com|org|net|edu|gov|mil|int|info|biz|name|io|co|me|dev|app|ai|example|test|local|de|fr|es|it|uk|us|ca|au|ch|at|nl|be|se|no|dk|fi|pl|pt|ie|nz|jp|cn|in|br|mx|eu"
ISSUERS = r"^(4|5[1-5]|2[2-7]|3[47]|6011|64[4-9]|65|35|30[0-5]|36|38|62)"
CALLING = r"^(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|21[1-368]|35[0-9]|37[0-9]|38[0-9]|42[013]|96[0-8]|97[1-7])"
NOBODY = r"^(0|127|22[4-9]|23[0-9]|24[0-9]|25[0-5])\."
PERSONAL = "mail|contact|phone|tel|call|fax|mobile|card|visa|account|ssn|social|address|host|login"
OTHER = "version|release|build|section|figure|page|order|invoice|serial|isbn|issn|model|part no"
NEAR = 40
LABELERS = ("form", "rule", "gazetteer", "context", "edges")
SPAN = "struct<start:int,kind:int,end:int,valid:boolean,votes:string,shape:string>"


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, though lambdas in the body use it many times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, op, width: int = 128) -> Column:
    """Running fold of an int array by ``op``, of which 0 is neutral: folds within blocks, then over their ends."""
    none = F.array().cast("array<int>")
    fold = lambda v: F.aggregate(v, none, lambda a, x: F.concat(a, F.array(op(F.coalesce(F.get(a, F.size(a) - 1), F.lit(0)), x).cast("int"))))

    def whole(v: Column) -> Column:
        cuts = F.transform(F.sequence(F.lit(0), ((F.size(v) - 1) / width).cast("int")), lambda b: fold(F.slice(v, b * width + 1, width)))
        return let(cuts, lambda c: let(fold(F.transform(c, lambda x: F.get(x, F.size(x) - 1))), lambda ends: F.flatten(F.transform(c, lambda x, i: F.transform(x, lambda y: op(F.coalesce(F.get(ends, i - 1), F.lit(0)), y))))))

    return let(values, lambda v: F.when(F.size(v) == 0, none).when(F.size(v) <= width, fold(v)).otherwise(whole(v)))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _valid(kind: str, m: Column) -> Column:
    digits = _digits(m)
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: p.try_cast("double") <= 255)
    if kind in ("card", "inner_card"):
        return F.length(digits).between(12, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return m.isNotNull()


def _say(yes: Column, no: Column | None = None) -> Column:
    """y, n, or a where neither holds; without ``no`` the rest is n."""
    return F.when(yes, "y").when(F.lit(True) if no is None else no, "n").otherwise("a")


def _votes(kind: str, m: Column, before: Column, edge: Column, valid: Column) -> Column:
    """One letter a labeler: y, n or a (abstains)."""
    digits, silent = _digits(m), F.lit("a")
    if kind in ("email", "spelled_email"):
        end = F.regexp_extract(F.lower(m), r"([a-z0-9-]+)$", 1)
        form = _say(m.rlike("^[A-Za-z0-9]") & ~F.contains(m, F.lit("..")))
        rule = _say(end.rlike("^[a-z]{2,}$"))
        gazetteer = _say(end.rlike(f"^({DOMAINS})$"))
    elif kind == "ip":
        form, rule, gazetteer = _say(~m.rlike(r"(^|\.)0[0-9]")), _say(valid), _say(~m.rlike(NOBODY))
    elif kind in ("card", "inner_card"):
        form = _say(m.rlike(r"^([0-9]{4}[\x20-][0-9]{4}[\x20-][0-9]{4}[\x20-][0-9]{4}|[0-9]{4}[\x20-][0-9]{6}[\x20-][0-9]{5}|[0-9]{13,19})$"))
        rule, gazetteer = _say(valid), _say(digits.rlike(ISSUERS))
    elif kind == "phone":
        form, rule, gazetteer = _say(m.rlike(r"[\x20().-]"), F.length(digits) > 13), _say(valid), _say(digits.rlike(CALLING))
    elif kind == "local_phone":
        form = _say(m.rlike(r"^(\([0-9]{3}\)\x20[0-9]{3}-|[0-9]{3}-[0-9]{3}-|[0-9]{3}\.[0-9]{3}\.)"), m.rlike(r"^(\([0-9]{3}[^)]|[0-9]{3}\))"))
        rule, gazetteer = _say(digits.rlike("^[2-9]..[2-9]")), _say(~digits.rlike("^.11"))
    else:
        form, rule, gazetteer = silent, _say(~digits.rlike("^(000|666|9)|^...00|0000$")), silent
    context = _say(before.rlike(PERSONAL), before.rlike(OTHER))
    return F.concat(form, rule, gazetteer, context, _say(~edge.rlike(r"[A-Za-z0-9_]")))


def _shape(m: Column) -> Column:
    """Number of digits, signs between them, and length, in classes: what the classifier sees beside votes."""
    n = F.length(_digits(m))
    digits = F.when(n == 0, "0").when(n < 9, "1").when(n < 12, "2").when(n < 16, "3").otherwise("4")
    signs = m.rlike(r"\x20").cast("int") + 2 * m.rlike("-").cast("int") + 4 * m.rlike(r"\.").cast("int")
    return F.concat(digits, signs.cast("string"), F.when(F.length(m) < 12, "0").when(F.length(m) < 20, "1").otherwise("2"))


def _spans(text: Column, kind: str) -> Column:
    """Matches of one kind by start, those that fail their rule marked: the pieces between matches give the positions."""
    pattern, inner = F.lit(PATTERNS[kind]), kind == "inner_card"
    both = F.struct(F.split(text, PATTERNS[kind], -1).alias("p"), F.regexp_extract_all(text, pattern, F.lit(int(inner))).alias("m"))
    taken = lambda m: F.lit(1) if inner else F.length(m)

    def span(s: Column, ends: Column, m: Column, i: Column) -> Column:
        start = F.get(ends, i) - taken(m)
        lead = F.concat(F.coalesce(F.get(s["m"], i - 1), F.lit("")), F.get(s["p"], i))
        after = F.lit("") if inner else F.concat(F.get(s["p"], i + 1), F.coalesce(F.get(s["m"], i + 1), F.lit("")))
        edge = F.concat(F.right(lead, F.lit(1)), F.lit(" "), F.substring(after, 1, 1))
        valid = F.coalesce(_valid(kind, m), F.lit(False))
        return F.struct(
            start.alias("start"),
            F.lit(KINDS.index(kind)).alias("kind"),
            (start + F.length(m)).alias("end"),
            valid.alias("valid"),
            _votes(kind, m, F.lower(F.right(lead, F.lit(NEAR))), edge, valid).alias("votes"),
            _shape(m).alias("shape"),
        )

    def found(s: Column) -> Column:
        lengths = F.transform(s["m"], lambda m, i: F.length(F.get(s["p"], i)) + taken(m))
        worth = lambda m: F.length(_digits(m)) >= NEAR_CARD if kind == "card" else F.lit(True)
        spans = let(running(lengths, lambda a, x: a + x), lambda ends: F.transform(s["m"], lambda m, i: F.when(worth(m), span(s, ends, m, i))))
        return F.filter(spans, lambda x: x.isNotNull()).cast(f"array<{SPAN}>")

    none = F.array().cast(f"array<{SPAN}>")
    hint = F.contains(text, F.lit(HINTS[kind])) if kind in HINTS else text.rlike(r"[0-9][\x20.)-]?[0-9]")
    return F.when(hint, let(both, lambda s: F.when(F.size(s["m"]) > 0, found(s)).otherwise(none))).otherwise(none)


def _apart(base: Column, extra: Column) -> Column:
    """Those of ``extra`` that overlap no valid span of ``base``: base spans are sorted, and the greatest end up to
    each is kept, so that a binary search answers for every one."""

    def search(b: Column, most: Column) -> Column:
        rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.size(b) + F.lit(1.0))).cast("int"))

        def step(a: Column, _: Column, end: Column) -> Column:
            mid = ((a["lo"] + a["hi"]) / 2).cast("int")
            right = (a["lo"] < a["hi"]) & (F.get(b, mid)["start"] < end)
            return F.struct(F.when(right, mid + 1).otherwise(a["lo"]).alias("lo"), F.when(right | (a["lo"] >= a["hi"]), a["hi"]).otherwise(mid).alias("hi"))

        before = lambda end: F.aggregate(rounds, F.struct(F.lit(0).alias("lo"), F.size(b).alias("hi")), lambda a, r: step(a, r, end), lambda a: a["lo"])
        return F.filter(extra, lambda x: F.coalesce(F.get(most, before(x["end"]) - 1), F.lit(0)) <= x["start"])

    solid = F.array_sort(F.filter(base, lambda s: s["valid"]))
    held = let(solid, lambda b: let(running(F.transform(b, lambda s: s["end"]), lambda a, x: F.greatest(a, x)), lambda most: search(b, most)))
    return F.when((F.size(extra) == 0) | (F.size(base) == 0), extra).otherwise(held)


def candidates(text: Column) -> Column:
    """All spans of a text, by start, then kind; proposals that overlap a base span are left out.

    Spans of base kinds that fail their rule are marked so; proposals may overlap each other.
    """
    sides = F.struct(F.concat(*[_spans(text, k) for k in BASE]).alias("b"), F.concat(*[_spans(text, k) for k in EXTRA]).alias("e"))
    return let(sides, lambda s: F.array_sort(F.concat(s["b"], _apart(s["b"], s["e"]))))


Cell = tuple[int, str, str]


def reliabilities(counts: dict[Cell, int], rounds: int = 100) -> tuple[list[Cell], np.ndarray, np.ndarray, np.ndarray]:
    """EM over the cells (kind, votes, shape): the cells, their posteriors, and each labeler's rates of yes for real
    and for other spans. Abstentions say nothing; every kind has its own share of real spans; weak priors say
    that a labeler is right more often than not."""
    cells = sorted(counts)
    n = np.array([counts[c] for c in cells], float)
    kind = np.array([k for k, _, _ in cells])
    vote = np.array([[{"y": 1.0, "n": 0.0, "a": np.nan}[v] for v in votes] for _, votes, _ in cells])
    said, yes = ~np.isnan(vote), np.nan_to_num(vote)
    labelers = vote.shape[1]
    real, other, prior = np.full(labelers, 0.8), np.full(labelers, 0.3), np.full(len(KINDS), 0.5)
    for _ in range(rounds):
        p = prior[kind]
        log = np.log(p / (1 - p)) + np.where(said, yes * np.log(real / other)[None, :] + (1 - yes) * np.log((1 - real) / (1 - other))[None, :], 0).sum(axis=1)
        post = 1 / (1 + np.exp(-np.clip(log, -30, 30)))
        w1, w0 = (n * post)[:, None] * said, (n * (1 - post))[:, None] * said
        real = np.clip(((w1 * yes).sum(0) + 8) / (w1.sum(0) + 10), 0.01, 0.99)
        other = np.clip(((w0 * yes).sum(0) + 3) / (w0.sum(0) + 10), 0.01, 0.99)
        mass, hits = np.bincount(kind, n, len(KINDS)), np.bincount(kind, n * post, len(KINDS))
        prior = np.clip((hits + 5) / (mass + 10), 0.05, 0.95)
    return cells, post, real, other


def _features(cells: list[Cell]) -> np.ndarray:
    votes = np.array([[{"y": 1.0, "n": -1.0, "a": 0.0}[v] for v in c[1]] for c in cells])
    one = lambda values, n: np.eye(n)[np.array(values, int)]
    shape = [one([c[2][i] for c in cells], n) for i, n in enumerate((5, 8, 3))]
    return np.hstack([votes, one([c[0] for c in cells], len(KINDS)), *shape])


def estimate(counts: dict[Cell, int]) -> dict[Cell, float]:
    """Probability of each cell by the logistic classifier that the posteriors of EM train."""
    if not counts:
        return {}
    cells, post, _, _ = reliabilities(counts)
    x = _features(cells)
    w = logistic(x, post, ridge=1.0, weight=np.array([counts[c] for c in cells], float))
    return dict(zip(cells, apply_logistic(w, x).tolist()))


def train(spans: DataFrame, column: str = "spans") -> dict[Cell, float]:
    """Cell probabilities from a table with a column of candidates()."""
    cells = spans.select(F.explode(column).alias("s")).groupBy("s.kind", "s.votes", "s.shape").count().collect()  # kinds x 3 ** labelers x 120 shapes at most
    return estimate({(r["kind"], r["votes"], r["shape"]): r["count"] for r in cells})


def accepted(spans: Column, model: dict[Cell, float]) -> Column:
    """Base spans that hold their rule, and the proposals whose cell the classifier accepts."""
    good = [f"{k}{v}{s}" for (k, v, s), p in sorted(model.items()) if k >= len(BASE) and p >= 0.5]
    return F.filter(spans, lambda s: s["valid"] & ((s["kind"] < len(BASE)) | F.concat(s["kind"].cast("string"), s["votes"], s["shape"]).isin(*good)))


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def detect(docs: DataFrame) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: n_email, n_ip, n_card, n_phone, base_sha256, spans, n_extra.

    A null or empty text has no spans; a long text takes time in proportion; repeated rows each give a row; spans
    that start together come in the order of kinds; an empty table gives no rows; other columns are ignored.
    """
    found = cut(docs.select("doc_id", candidates(F.coalesce("text", F.lit(""))).alias("spans")))
    kept = found.select("doc_id", accepted(F.col("spans"), train(found)).alias("spans"))
    of = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == KINDS.index(k))).cast("bigint").alias(f"n_{k}")
    return kept.select(
        "doc_id",
        *[of(k) for k in BASE],
        F.sha2(_joined(F.filter("spans", lambda s: s["kind"] < len(BASE))).cast("binary"), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["kind"] >= len(BASE))).cast("bigint").alias("n_extra"),
    )


def _replaced(text: Column, spans: Column, block: int = 1024) -> Column:
    """``text`` with spans given way to the names of their kinds; of overlapping spans the first names all."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def rebuilt(s: Column, most: Column, parts: Column) -> Column:
        def piece(a: Column, b: Column) -> Column:
            i = F.floor(a / block).cast("int")
            lines = F.array_join(F.slice(parts, i + 1, F.floor(b / block).cast("int") - i + 1), "")
            return F.substring(lines, a - i * block + 1, b - a)

        ahead = lambda i: F.coalesce(F.get(most, i - 1), F.lit(0))
        each = F.transform(s, lambda x, i: F.when(x["start"] >= ahead(i), F.concat(piece(ahead(i), x["start"]), F.get(names, x["kind"]))).otherwise(F.lit("")))
        return F.concat(F.array_join(each, ""), piece(F.get(most, F.size(most) - 1), F.length(text)))

    parts = F.transform(F.sequence(F.lit(0), F.floor(F.length(text) / block).cast("int")), lambda i: F.substring(text, i * block + 1, F.lit(block)))
    most = lambda s: running(F.transform(s, lambda x: x["end"]), lambda a, x: F.greatest(a, x))
    whole = let(spans, lambda s: let(most(s), lambda m: let(parts, lambda p: rebuilt(s, m, p))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every accepted span of text replaced by its kind in brackets; other columns as they are.

    Spans are found once and kept with their rows. Null and empty texts stay as they are.
    """
    (name,) = fresh(docs, "_spans")
    found = cut(docs.withColumn(name, candidates(F.coalesce("text", F.lit("")))))
    return found.withColumn("text", let(accepted(F.col(name), train(found, name)), lambda s: _replaced(F.col("text"), s))).drop(name)
