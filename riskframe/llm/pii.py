"""Personal data: overlapping candidate spans, scored by boosted trees, with calibrated thresholds.

The base rules find e-mail addresses, IPv4 addresses, card and phone numbers.  High-recall generators
propose further, overlapping spans (obfuscated addresses, local phone formats, bare digit strings,
IPv6).  Boosted trees score each proposal by its format and context; a proposal is added if its score
reaches its kind's threshold, which is calibrated on held-out candidates.  Scoring is one projection:
the trees are compiled into ``CASE`` expressions, so the main path has no user functions.

There are no labels for personal data, so the trees learn from examples made by rule: values in forms
that the base rules do not cover (obfuscated addresses, local and 00-prefixed phone numbers, dotted card
numbers, IPv6) are set into sampled texts as positives; look-alikes (dates, clock times, hardware
addresses, numbers that fail Luhn, sentence ends after an ``@``) as negatives, together with what the
generators propose in the sampled texts themselves where no word nearby speaks for the kind.
"""
from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
_CLASS = "A-Za-z0-9._%+-"
# Fixed patterns of the base kinds.  A local part and a number begin where a run begins or where the
# last match ended, which is where the leftmost match begins; so long runs take linear time.
_EMAIL = rf"(?:(?<![{_CLASS}])|\G)[{_CLASS}]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
_IP = r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"
_DIGIT_RUN = r"[0-9][0-9 -]*[0-9]"
_GAP = r"[ -]{2,}"
_PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
#: Proposals by kind, beside the base spans.  Fixed patterns.
GENERATORS = {
    "email": r"[A-Za-z0-9._%+-]{1,64} ?(?:\[at\]|\(at\)|\{at\}|@) ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|\[dot\]|\(dot\)) ?[A-Za-z0-9-]{1,63}){1,4}",
    "ip": r"(?<![0-9A-Fa-f:.])(?:[0-9A-Fa-f]{1,4}:){2,7}:?(?:[0-9A-Fa-f]{1,4}:){0,5}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])[0-9]{4}(?:[ ./-]?[0-9]{3,7}){2,4}(?![0-9])",
    "phone": r"(?<![0-9+.])(?:00[0-9]{1,3}[ .-]?)?\(?[0-9]{2,5}\)?(?:[ ./-][0-9]{2,8}){1,4}(?![0-9])",
}
#: Words near a span that speak for its kind.  Fixed patterns.
CONTEXT = {
    "email": r"(?i)e-?mail|contact|write|@|correo|courriel",
    "ip": r"(?i)\bip\b|host|server|address|adresse",
    "card": r"(?i)card|visa|master|amex|iban|karte|carte|tarjeta",
    "phone": r"(?i)phone|tel|call|fax|mobile|handy|tél|teléfono",
}
FEATURES = ("length", "digits", "separators", "letters", "groups", "opens_plus", "brackets", "longest_digits",
            "before_letter", "after_letter", "context", "spaces", "longest_group", "last_group", "opens_00", "luhn", "doubles")


def _let(value: Column, use) -> Column:
    return F.element_at(F.transform(F.array(value), use), 1)


def _placed(pieces: Column, matches: Column) -> Column:
    """(start, end, match) of each match; ``pieces`` are the texts between them."""
    def step(acc, k):
        start = acc["at"] + F.length(F.get(pieces, k))
        end = start + F.length(F.get(matches, k))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(
            F.struct(start.alias("s"), end.alias("e"), F.get(matches, k).alias("m")))).alias("out"))
    zero = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<s:int,e:int,m:string>>)").alias("out"))
    return F.aggregate(F.sequence(F.lit(0), F.size(matches) - 1), zero, step, lambda a: a["out"])


def _none() -> Column:
    return F.expr("cast(array() as array<struct<s:int,e:int,m:string>>)")


def _spans(text: Column, pattern: str, probe: Column) -> Column:
    """All leftmost non-overlapping matches in code points; ``probe`` says if there can be one."""
    found = _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.when(F.size(m) == 0, _none()).otherwise(
        _let(F.split(text, pattern, -1), lambda p: _placed(p, m))))
    return F.when(probe, found).otherwise(_none())


def _pieces(run: Column) -> Column:
    """Parts of a digit run between gaps of two or more separators, placed in the text."""
    def cut(parts, gaps):
        def step(acc, k):
            start = acc["at"]
            end = start + F.length(F.get(parts, k))
            gap = F.coalesce(F.length(F.get(gaps, k)), F.lit(0))
            return F.struct((end + gap).alias("at"), F.concat(acc["out"], F.array(
                F.struct(start.alias("s"), end.alias("e"), F.get(parts, k).alias("m")))).alias("out"))
        zero = F.struct(run["s"].alias("at"), _none().alias("out"))
        return F.aggregate(F.sequence(F.lit(0), F.size(parts) - 1), zero, step, lambda a: a["out"])
    return _let(F.split(run["m"], _GAP, -1), lambda parts: _let(
        F.regexp_extract_all(run["m"], F.lit(_GAP), F.lit(0)), lambda gaps: cut(parts, gaps)))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _octets_ok(m: Column) -> Column:
    def ok(p):
        v = F.ltrim(p, F.lit("0"))
        return (F.length(v) <= 3) & (F.coalesce(v.try_cast("int"), F.lit(0)) <= 255)
    return F.forall(F.split(m, r"\."), ok)


def base_spans(text: Column) -> dict[str, Column]:
    """Valid spans of each kind as arrays of (s, e, m)."""
    digit = text.rlike("[0-9]")
    n = lambda x: F.length(_digits(x["m"]))
    runs = _spans(text, _DIGIT_RUN, text.rlike(r"[0-9][0-9 -]{14,}[0-9]"))
    cards = F.flatten(F.transform(F.filter(runs, lambda r: F.length(r["m"]) >= 16), _pieces))
    return {
        "email": _spans(text, _EMAIL, F.contains(text, F.lit("@"))),
        "ip": F.filter(_spans(text, _IP, text.rlike(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]")), lambda x: _octets_ok(x["m"])),
        "card": F.filter(cards, lambda x: n(x).between(16, 19) & F.call_function("luhn_check", _digits(x["m"]))),
        "phone": F.filter(_spans(text, _PHONE, F.contains(text, F.lit("+")) & digit), lambda x: n(x).between(8, 15)),
    }


def _features(text: Column, kind: str, x: Column) -> list[Column]:
    m = x["m"]
    count = lambda p: F.length(F.regexp_replace(m, p, ""))
    near = F.substring(text, F.greatest(x["s"] - 29, F.lit(1)), F.least(x["s"], F.lit(30)))
    return [c.cast("double") for c in (
        F.length(m), count("[^0-9]"), count("[^ ./:()-]"), count("[^A-Za-z]"), F.regexp_count(m, F.lit("[0-9A-Za-z]+")),
        m.startswith("+"), m.rlike(r"[\[({]"),
        F.array_max(F.transform(F.split(m, "[^0-9]+"), lambda d: F.length(d))),
        F.substring(text, x["s"], F.lit(1)).rlike(r"\p{L}") & (x["s"] > 0),
        F.substring(text, x["e"] + 1, F.lit(1)).rlike(r"\p{L}"), near.rlike(CONTEXT[kind]),
        F.regexp_count(m, F.lit(" ")), F.array_max(F.transform(F.split(m, "[^0-9A-Za-z]+"), lambda g: F.length(g))),
        F.length(F.regexp_extract(m, "[0-9A-Za-z]*$", 0)), m.startswith("00"),
        F.coalesce(F.call_function("luhn_check", _digits(m)), F.lit(False)), F.regexp_count(m, F.lit("::")))]


def _proposals(text: Column, kind: str) -> Column:
    probe = F.contains(text, F.lit("@")) | F.lower(text).rlike(r"[\[({]at[\])}]") if kind == "email" else (
        text.rlike(r"[0-9A-Fa-f]:[0-9A-Fa-f]") if kind == "ip" else text.rlike(r"[0-9]{2}"))
    return _spans(text, GENERATORS[kind], probe)


@dataclass
class Trees:
    """Boosted trees of one kind: margin = sum of weight * tree; a proposal is added from ``least`` on."""
    trees: list = field(default_factory=list)  # (weight, node); node = (feature, threshold, left, right) or a number
    least: float = float("inf")

    def margin(self, features: list[Column]) -> Column:
        def walk(node):
            if not isinstance(node, tuple):
                return F.lit(float(node))
            k, cut, left, right = node
            return F.when(features[k] <= cut, walk(left)).otherwise(walk(right))
        total = F.lit(0.0)
        for w, t in self.trees:
            total = total + F.lit(float(w)) * walk(t)
        return total


def _examples(kind: str, seed: Column) -> Column:
    """(cue, value, label) made from a hash: forms that the base rules miss, and look-alikes."""
    hexa = F.sha2(seed, 256)
    pool = F.rpad(F.regexp_replace(hexa, "[^0-9]", ""), 64, "7351924680")
    letters = F.translate(hexa, "0123456789", "ghijklmnop")
    vary = lambda i, lo, hi: F.pmod(F.xxhash64(seed, F.lit(i)), F.lit(hi - lo + 1)).cast("int") + lo
    d = lambda i, n, more=0: F.substring(pool, F.lit(i), vary(i, n, n + more))
    h = lambda i, n: F.substring(hexa, i, n)
    w = lambda i, lo, hi: F.substring(letters, F.lit(i), vary(i, lo, hi))
    join = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    if kind == "email":
        good = [(c, v) for c in ("", "contact ") for v in (
            join(w(1, 2, 10), " [at] ", w(12, 3, 10), " [dot] com"), join(w(2, 2, 10), "(at)", w(13, 3, 10), ".org"),
            join(w(3, 2, 8), ".", w(14, 3, 9), " @ ", w(24, 3, 10), ".net"), join(w(4, 2, 9), " (at) ", w(15, 3, 9), " (dot) de"))]
        bad = [(c, v) for c in ("", "write ") for v in (
            join(w(1, 2, 10), " @ ", w(12, 2, 10), ". ", w(24, 1, 10)), join(w(2, 2, 10), " (at) ", w(13, 2, 10), ". ", w(25, 1, 10)),
            join(w(3, 2, 10), " @", w(14, 2, 10), " . ", w(26, 1, 10)), join(w(4, 2, 10), "@ ", w(15, 2, 10), ". ", w(27, 1, 10)))]
    elif kind == "ip":
        groups = [h(1 + 4 * i, 4) for i in range(8)]
        pairs = [h(1 + 2 * i, 2) for i in range(6)]
        good = [(c, v) for c in ("", "host ") for v in (
            F.concat_ws(":", *groups), F.concat_ws(":", *groups[:6], h(40, 1), h(41, 2)),
            join(groups[0], ":", F.substring(hexa, F.lit(30), vary(30, 1, 4)), "::", F.substring(hexa, F.lit(34), vary(34, 1, 4))),
            join(groups[1], ":", groups[2], ":", F.substring(hexa, F.lit(20), vary(20, 1, 4)), "::", groups[3]))]
        bad = [(c, v) for c in ("", "server ") for v in (
            F.concat_ws(":", *pairs), join("1", d(1, 1), ":2", d(2, 1), ":3", d(3, 1)),
            join(d(4, 2), ":", d(6, 2), ":", d(8, 2), ":", d(10, 2)), join(d(12, 1), ":", d(13, 1), ":", d(14, 1)))]
    elif kind == "card":
        def closed(first, right=True):  # with a last digit that passes Luhn, or the one after it
            last = F.filter(F.array(*[F.lit(str(i)) for i in range(10)]), lambda c: F.call_function("luhn_check", F.concat(first, c)))
            last = F.element_at(last, 1)
            return F.concat(first, last if right else F.pmod(last.cast("int") + 1, F.lit(10)).cast("string"))
        cut = lambda x, by, *ns: F.concat_ws(by, *[F.substring(x, 1 + sum(ns[:i]), n) for i, n in enumerate(ns)])
        long = lambda right: closed(join("4", d(1, 14)), right)
        short = lambda right: closed(join("37", d(20, 12)), right)
        forms = lambda right: [cut(long(right), ".", 4, 4, 4, 4), cut(long(right), "/", 4, 4, 4, 4),
                               cut(short(right), " ", 4, 6, 5), cut(short(right), "-", 4, 6, 5)]
        good = [(c, v) for c in ("", "card ") for v in forms(True)]
        bad = [(c, v) for c in ("", "card ") for v in [*forms(False), join(d(30, 4), "-", d(34, 3), "-", d(37, 4))]]
    else:
        good = [(c, v) for c in ("", "phone ") for v in (
            join("00", d(1, 1, 1), " ", d(3, 2, 2), " ", d(7, 5, 3)), join("00", d(1, 1, 1), "-", d(3, 3), "-", d(6, 3), "-", d(9, 4)),
            join("(0", d(1, 2, 2), ") ", d(5, 3), " ", d(8, 3, 2)))] + [
            ("call ", join("0", d(1, 2, 2), " ", d(5, 3), " ", d(8, 3, 2))), ("phone: ", join("0", d(1, 2, 2), "-", d(5, 3), "-", d(8, 3, 1))),
            ("fax ", join("0", d(1, 2, 2), "/", d(5, 5, 3)))]
        bad = [(c, v) for c in ("", "call ") for v in (
            join("20", d(1, 2), "-1", d(3, 1), "-2", d(4, 1)), join("2", d(5, 1), ".1", d(6, 1), ".20", d(7, 2)),
            join("1", d(8, 1), "/2", d(9, 1), "/19", d(10, 2)), join("19", d(12, 2), "-20", d(14, 2)),
            F.concat_ws(".", d(16, 4), d(20, 4), d(24, 4), d(28, 4)), F.concat_ws(" ", d(16, 4), d(20, 4), d(24, 4), d(28, 4)))] + [
            ("", join("3", d(16, 2), " ", d(19, 3), " ", d(22, 3))), ("", join(d(25, 2), ".", d(27, 2), ".", d(29, 2)))]
    return F.array(*[F.struct(F.lit(c).alias("cue"), v.alias("value"), F.lit(float(y)).alias("label"))
                     for y, some in ((1, good), (0, bad)) for c, v in some])


def _set_in(hosts: DataFrame, kind: str) -> DataFrame:
    """text and (s, e, m) and label of the proposals that lie on an example set into a text."""
    plain = lambda x: F.regexp_replace(x, "[0-9@+:]", "")
    at = F.pmod(F.xxhash64("text", F.lit(kind)), F.length("text")).cast("int")
    d = hosts.select(plain(F.substring(F.col("text"), F.greatest(at - 39, F.lit(1)), F.lit(40))).alias("left"),
                     plain(F.substring(F.col("text"), at + 1, F.lit(40))).alias("right"),
                     F.explode(_examples(kind, F.concat("text", F.lit(kind)))).alias("v"))
    d = d.select(F.concat("left", F.lit(" "), "v.cue", "v.value", F.lit(" "), "right").alias("text"), "v.label",
                 (F.length("left") + 1 + F.length("v.cue")).alias("from"), F.length("v.value").alias("size"))
    end = F.col("from") + F.col("size")
    d = d.select("text", "label", "from", end.alias("to"), F.explode(_proposals(F.col("text"), kind)).alias("x"))
    exact = (F.col("x.s") == F.col("from")) & (F.col("x.e") == F.col("to"))
    touches = (F.col("x.s") < F.col("to")) & (F.col("x.e") > F.col("from"))
    return d.where(exact | ((F.col("label") == 0) & touches)).select("text", "x", "label")


def _apart(x: Column, spans: Column) -> Column:
    return ~F.exists(spans, lambda b: (b["s"] < x["e"]) & (b["e"] > x["s"]))


def fit(docs: DataFrame, sample_docs: int = 4000, precision: float = 0.95, rounds: int = 8, depth: int = 3) -> dict[str, Trees]:
    """Trees and thresholds of each kind, from examples set into about ``sample_docs / 4`` sampled texts and
    the proposals of about ``sample_docs`` that hold a digit or an ``@``.  Equal texts are sampled once, and the
    sample is stored, so the table is read twice whatever the number of kinds.

    A fifth of the candidates, by a hash of their text, is held out; the threshold is the lowest score
    from which on held-out candidates, which are all proposals that the base rules miss, reach
    ``precision``.  Without any text nothing is learned and nothing is added.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    from .common import drop, keep
    text = F.col("text")
    rows = docs.select(text.cast("string").alias("text")).where(F.length("text") > 0)
    some = text.rlike(r"[0-9]{2}|@")
    n = rows.agg(F.count(F.lit(1)).alias("all"), F.count_if(some).alias("some")).first()
    if not n["all"]:
        return {kind: Trees() for kind in KINDS}
    draw = F.pmod(F.xxhash64("text"), F.lit(1 << 20))
    own, host = some & (draw * n["some"] < sample_docs * (1 << 20)), draw * n["all"] < (sample_docs // 4) * (1 << 20)
    sample = keep(rows.where(own | host).select("text", own.alias("own"), host.alias("host")).distinct(), "pii-sample")
    rows, hosts = sample.where("own"), sample.where("host")
    out = {}
    for kind in KINDS:
        loose = rows.select("text", *[c.alias(k) for k, c in base_spans(text).items()], _proposals(text, kind).alias("loose")) \
                    .select("text", F.flatten(F.array(*KINDS)).alias("base"), F.explode("loose").alias("x")) \
                    .where(_apart(F.col("x"), F.col("base"))).select("text", "x", F.lit(0.0).alias("label"))
        cand = loose.withColumn("own", F.lit(True)).unionByName(_set_in(hosts, kind).withColumn("own", F.lit(False)))
        table = keep(cand.select(
            *[f.alias(name) for f, name in zip(_features(text, kind, F.col("x")), FEATURES)], "label", "own",
            F.pmod(F.xxhash64("text", "x.s", "x.e"), F.lit(5)).alias("part"))
            .where(~F.col("own") | (F.col("context") == 0)).repartition(4), f"pii-{kind}")
        if len(table.where("part > 0").groupBy("label").count().collect()) < 2:  # too few texts to learn from
            out[kind] = Trees()
            drop(table)
            continue
        data = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(table)
        model = GBTClassifier(maxIter=rounds, maxDepth=depth, seed=7, minInstancesPerNode=5, cacheNodeIds=False) \
            .fit(data.where("part > 0").select("features", "label"))
        trees = Trees([(w, _node(t._call_java("rootNode"))) for w, t in zip(model.treeWeights, model.trees)])
        scored = table.where("part = 0").select(trees.margin([F.col(c) for c in FEATURES]).alias("margin"), "label")
        # the margin is at most twice the sum of the weights, so there are a few thousand steps at most
        steps = scored.groupBy((F.floor(F.col("margin") * 100) / 100).alias("m")) \
                      .agg(F.sum("label").alias("good"), F.count("label").alias("n")).orderBy(F.desc("m")).collect()
        good = total = 0
        for s in steps:
            good, total = good + s["good"], total + s["n"]
            if s["m"] >= 0 and good / total >= precision:  # and more likely than not on its own
                trees.least = s["m"]
        out[kind] = trees
        drop(table)
    drop(sample)
    return out


def _node(node):
    if node.subtreeDepth() == 0:
        return node.prediction()
    split = node.split()
    return split.featureIndex(), split.threshold(), _node(node.leftChild()), _node(node.rightChild())


def find(docs: DataFrame, model: dict[str, Trees] | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, text and one array column of (s, e, m) spans per kind and use.

    ``email, ip, card, phone`` hold the valid base spans; ``more_email`` and so on what the trees add:
    proposals that overlap no base span of any kind and whose score reaches the threshold.  Added spans of
    different kinds may overlap each other.  A null or empty text has no spans; repeated rows give equal
    results; other columns are ignored; an empty table gives an empty result.
    """
    text = F.col("text")
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(text.cast("string"), F.lit("")).alias("text"))
    base = d.select("doc_id", "text", *[c.alias(k) for k, c in base_spans(text).items()])
    more = []
    for k in KINDS:
        trees = (model or {}).get(k, Trees())
        if trees.least == float("inf"):
            more.append(_none().alias(f"more_{k}"))
            continue
        more.append(F.filter(_proposals(text, k), _added(text, k, trees)).alias(f"more_{k}"))
    return base.select("*", *more)


def _added(text: Column, kind: str, trees: Trees):
    """Whether a proposal that overlaps no base span reaches the threshold."""
    def test(x):
        apart = [_apart(x, F.col(k)) for k in KINDS]
        return apart[0] & apart[1] & apart[2] & apart[3] & (trees.margin(_features(text, kind, x)) >= trees.least)
    return test


def listed(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda x: F.concat_ws(":", F.lit(kind), x["s"].cast("string"), x["e"].cast("string")))


def redact(docs: DataFrame, model: dict[str, Trees] | None = None) -> DataFrame:
    """``doc_id`` and the text with every found span replaced by its kind in square brackets."""
    found = find(docs, model)
    tag = lambda k: lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(k).alias("k"))
    tagged = F.flatten(F.array(*[F.transform(F.col(c), tag(k)) for k in KINDS for c in (k, f"more_{k}")]))

    def step(acc, x):  # spans in order; one that begins inside an earlier one only extends what is cut
        gap = F.substring(F.col("text"), acc["at"] + 1, x["s"] - acc["at"])
        new = F.struct(x["e"].alias("at"), F.concat(acc["out"], gap, F.lit("["), x["k"], F.lit("]")).alias("out"))
        old = F.struct(F.greatest(acc["at"], x["e"]).alias("at"), acc["out"].alias("out"))
        return F.when(x["s"] >= acc["at"], new).otherwise(old)
    done = F.aggregate(F.array_sort(tagged), F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step)
    return found.select("doc_id", "text", done.alias("d")).select(
        "doc_id", F.concat("d.out", F.substring("text", F.col("d.at") + 1, F.length("text"))).alias("text"))
