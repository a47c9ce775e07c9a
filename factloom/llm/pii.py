"""Personal data and secrets in texts, with DataFrame functions alone.

Base patterns always count. Beside them, generators with high recall propose overlapping candidates in what the base spans
leave; boosted trees score each from its format and the words before it, and thresholds, calibrated for each kind on texts
of forms that the trees have not seen, select what is added. The trees are fitted on a generated table of `TRAIN_ROWS`
rows and become CASE expressions.

The patterns are written so that no text makes them slow: a match is tried once for each run of characters, and
repeated groups are possessive, which the JVM runs without recursion; both find what the plain patterns find. Spans are
collected, compared and replaced in blocks, so that a text with many of them costs no square of their number.

Defined results: a null or empty text has no spans; null ids and equal rows are treated like others; an empty table
gives an empty result; all columns of docs are kept by `redact`. U+0001 to U+0003 in a text count as other characters.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "id", "secret")
EMAIL, IP, CARD, PHONE, ID, SECRET = range(6)
NONE = -1

# The base patterns.
BASE = {
    EMAIL: r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    IP: r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    CARD: r"[0-9](?:[\x20-]?[0-9])++",
    PHONE: r"\+[0-9][\x20().0-9-]+[0-9]",
}
OCTETS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(?:\.|$)){4}"

#: Generators of further candidates: kind and pattern.
MORE = (
    (EMAIL, r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}+ ?(?:\[at\]|\(at\)|<at>| at ) ?[a-z0-9-]{1,63}+ ?(?:\[dot\]|\(dot\)|<dot>| dot ) ?[a-z]{2,24}+(?![a-z0-9])"),
    (IP, r"(?<![0-9A-Fa-f:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"),
    (CARD, r"(?<![0-9A-Za-z.-])[0-9](?:[\x20-]?[0-9]){11,14}(?![0-9A-Za-z-])"),
    (PHONE, r"(?<![0-9A-Za-z+.-])\(?[0-9]{3}\)?[\x20.-]{1,2}[0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z.-])"),
    (PHONE, r"(?<![0-9A-Za-z.-])00[0-9](?:[\x20().-]?[0-9]){8,13}(?![0-9A-Za-z-])"),
    (ID, r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"),
    (ID, r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])"),
    (SECRET, r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]{0,64}+[0-9])(?=[0-9_+/-]{0,64}+[A-Za-z])[A-Za-z0-9_+/-]{8,200}+(?![A-Za-z0-9_+/-])"),
)
#: No generator's match is longer, in code points.
LONGEST = 256
#: What a text must hold for a generator to be tried.
MORE_NEEDS = (r"(?i)[\[(<\x20]dot[\])>\x20]", r":[0-9A-Fa-f]{1,4}:", r"[0-9][0-9\x20-]{10}", r"[0-9]{3}\)?[\x20.-]", r"00[0-9]", r"[0-9]-[0-9]{2}-[0-9]", r"[A-Z]{2}[0-9]{2}", r"[A-Za-z][0-9]|[0-9][A-Za-z]")

CUES = {
    EMAIL: r"(?i)(?:e-?mail|mail|contact|write|reach|address)\W{0,4}(?:\w+\W{1,3}){0,3}$",
    IP: r"(?i)(?:\bip|ipv6|host|server|address|from|login)\W{0,4}(?:\w+\W{1,3}){0,3}$",
    CARD: r"(?i)(?:card|visa|amex|credit|debit|payment)\W{0,4}(?:\w+\W{1,3}){0,3}$",
    PHONE: r"(?i)(?:phone|tel|call|fax|mobile|cell|dial|reach|contact)\W{0,4}(?:\w+\W{1,3}){0,3}$",
    ID: r"(?i)(?:ssn|social security|iban|account|passport|tax id)\W{0,4}(?:\w+\W{1,3}){0,3}$",
    SECRET: r"(?i)(?:passw(?:or)?d|passwd|pwd|passphrase|secret|token|api[ _-]?key|access[ _-]?key|private[ _-]?key|credentials?|bearer|auth)[\w\x22']{0,12}\s{0,2}(?:[:=]{1,2}>?|\bis\b)?\s{0,2}[\x22'`]?$",
}
AGAINST = r"(?i)(?:order|isbn|issn|version|invoice|serial|part|item|ref|reference|page|build|tracking|code|model|no|nr|sku|total|price|[$€£#=])\W{0,3}(?:\w+\W{1,3}){0,1}$"
CONTEXT = 40

TRAIN_ROWS = 4000
TREES, DEPTH, RATE = 30, 3, 0.3
#: The share of selected candidates of a kind that must be right on the calibration rows.
LEAST_PRECISION = 0.98
FEATURES = ("kind", "digits", "signs", "opened", "cue", "against", "luhn", "words", "length", "assigned")

_SPAN = "struct<k:int,s:int,e:int,m:string,b:string>"
#: Entries of an array that are folded at once.
FOLD = 64


def let(value: Column, fn) -> Column:
    """fn(value), which is computed once."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def blocks(n: Column) -> Column:
    """Numbers of the blocks of an array of n entries."""
    return F.sequence(F.lit(0), F.greatest(F.ceil(n / FOLD).cast("int") - 1, F.lit(0)))


def block(values: Column, k: Column) -> Column:
    return F.slice(values, k * FOLD + 1, F.lit(FOLD))


def running(values: Column, both) -> Column:
    """Before each of a few values what those before it fold to, from 0, and at the end what all do."""
    start = F.struct(F.lit(0).alias("now"), F.array(F.lit(0)).alias("all"))
    step = lambda acc, x: let(both(acc["now"], x), lambda now: F.struct(now.alias("now"), F.concat(acc["all"], F.array(now)).alias("all")))
    return F.aggregate(values, start, step, lambda acc: acc["all"])


def cleaned(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), "\u0001\u0002\u0003", "\u0004\u0004\u0004")


def found(text: Column, pattern: str, kind: int) -> Column:
    """Leftmost non-overlapping matches: kind, start, end (code points), the match and what stands before it."""

    def step(acc: Column, part: Column) -> Column:
        end = acc["at"] + F.char_length(part)
        span = F.struct(F.lit(kind).alias("k"), acc["at"].alias("s"), end.alias("e"), part.alias("m"), acc["b"].alias("b"))
        spans = F.when(acc["inside"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        before = F.when(acc["inside"], F.lit("")).otherwise(F.right(part, F.lit(CONTEXT)))
        return F.struct(end.alias("at"), (~acc["inside"]).alias("inside"), before.alias("b"), spans.alias("spans"))

    def spans(parts: Column) -> Column:
        # matches are every other part; a block has an even number of parts
        sizes = F.transform(blocks(F.size(parts)), lambda k: F.aggregate(block(parts, k), F.lit(0), lambda n, part: n + F.char_length(part)))
        start = lambda at: F.struct(at.alias("at"), F.lit(False).alias("inside"), F.lit("").alias("b"), F.array().cast(f"array<{_SPAN}>").alias("spans"))
        one = lambda k, begins: F.aggregate(block(parts, k), start(F.get(begins, k)), step, lambda acc: acc["spans"])
        return let(running(sizes, lambda n, x: n + x), lambda begins: F.flatten(F.transform(blocks(F.size(parts)), lambda k: one(k, begins))))

    return let(F.split(F.regexp_replace(text, pattern, "\u0001$0\u0002"), "[\u0001\u0002]"), spans)


def spliced(text: Column, spans: Column, put) -> Column:
    """text with its spans (s, e and others, by s) replaced: put(span, fresh, n) is what stands for n characters of it,
    where fresh is whether no earlier span has touched it."""

    def one(piece: Column, first: Column, mine: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            fresh = x["s"] >= acc["at"]
            plain = F.when(fresh, F.substring(piece, acc["at"] - first + 1, x["s"] - acc["at"])).otherwise(F.lit(""))
            return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.concat(acc["out"], plain, put(x, fresh, F.greatest(x["e"] - F.greatest(acc["at"], x["s"]), F.lit(0)))).alias("out"))

        return F.aggregate(mine, F.struct(first.alias("at"), F.lit("").alias("out")), step, lambda acc: acc["out"])

    def joined(text: Column, spans: Column, ends: Column) -> Column:
        from_, to = lambda k: F.get(ends, k), lambda k: F.get(ends, k + 1)
        pieces = F.transform(blocks(F.size(spans)), lambda k: one(F.substring(text, from_(k) + 1, to(k) - from_(k)), from_(k), block(spans, k)))
        return F.concat(F.array_join(pieces, ""), F.substring(text, F.element_at(ends, -1) + 1, F.char_length(text)))

    def made(spans: Column) -> Column:
        last = F.transform(blocks(F.size(spans)), lambda k: F.aggregate(block(spans, k), F.lit(0), lambda n, x: F.greatest(n, x["e"])))
        return let(running(last, F.greatest), lambda ends: joined(text, spans, ends))

    return F.when(F.size(spans) > 0, let(spans, made)).otherwise(text)


def digits_of(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    back = F.reverse(digits)

    def term(i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(1), F.char_length(digits)), term), F.lit(0), lambda a, x: a + x) % 10 == 0


def base_spans(text: Column) -> Column:
    none = F.array().cast(f"array<{_SPAN}>")
    has_digit = text.rlike("[0-9]")
    n = lambda x: F.char_length(digits_of(x["m"]))
    return F.concat(
        F.when(F.contains(text, F.lit("@")), found(text, BASE[EMAIL], EMAIL)).otherwise(none),
        F.when(has_digit & F.contains(text, F.lit(".")), F.filter(found(text, BASE[IP], IP), lambda x: x["m"].rlike(OCTETS))).otherwise(none),
        F.when(has_digit, F.filter(found(text, BASE[CARD], CARD), lambda x: F.when(n(x).between(16, 19), luhn(digits_of(x["m"]))).otherwise(False))).otherwise(none),
        F.when(F.contains(text, F.lit("+")), F.filter(found(text, BASE[PHONE], PHONE), lambda x: n(x).between(8, 15))).otherwise(none),
    )


def candidates(text: Column) -> Column:
    none = F.array().cast(f"array<{_SPAN}>")
    return F.concat(*[F.when(text.rlike(need), found(text, pattern, kind)).otherwise(none) for (kind, pattern), need in zip(MORE, MORE_NEEDS, strict=True)])


def features(x: Column) -> Column:
    """Format and context of a candidate, as small whole numbers."""
    digits = digits_of(x["m"])
    n = F.char_length(digits)
    cue = F.lit(False)
    for kind, pattern in CUES.items():
        cue = cue | ((x["k"] == kind) & x["b"].rlike(pattern))
    return F.struct(
        x["k"].alias("kind"), F.least(n, F.lit(40)).alias("digits"), F.char_length(F.regexp_replace(x["m"], "[A-Za-z0-9]", "")).alias("signs"),
        x["m"].rlike(r"[(\[<+]").cast("int").alias("opened"), cue.cast("int").alias("cue"), x["b"].rlike(AGAINST).cast("int").alias("against"),
        F.when(n.between(12, 19), luhn(digits)).otherwise(False).cast("int").alias("luhn"), F.size(F.split(F.trim(x["b"]), r"\s+")).alias("words"),
        F.least(F.char_length(x["m"]), F.lit(64)).alias("length"), x["b"].rlike(r"[:=][\s\x22'`]{0,3}$").cast("int").alias("assigned"),
    )


# --- training ----------------------------------------------------------------------------------------------------

#: Texts of the generated table that the trees are fitted on, and the kind of what they hold. # stands for a digit,
#: @ for a word, % for a hexadecimal and & for any letter or digit, ^ for the check digit that makes the digits so far pass
#: Luhn's rule, ~ for one that does not.
TEMPLATES = (
    ("call me on ###-###-####", PHONE), ("phone: (###) ###-####", PHONE), ("tel ###.###.####", PHONE), ("my mobile is ### ### ####", PHONE), ("dial 00## ### ### ####", PHONE),
    ("and (###) ###-#### or so", PHONE), ("fax ###-###-####", PHONE), ("@ @ @ @ (###) ###-#### @", PHONE), ("contact: 0044 #### ######", PHONE),
    ("order ###-###-####", NONE), ("version ###.###.####", NONE), ("part no ### ### ####", NONE), ("serial ###-###-####", NONE), ("@ @ ### ### #### @", NONE), ("total: ### ### ####", NONE),
    ("tracking 00##########", NONE), ("@ ###.###.#### @ @", NONE), ("item 00## ### ### ####", NONE), ("@ @ 00########## @", NONE), ("@ @ @ ###-###-#### @", NONE),
    ("ssn ###-##-####", ID), ("social security number ###-##-####", ID), ("iban DE## #### #### #### #### ##", ID), ("account GB##@### #### #### ####", ID),
    ("serial ###-##-####", NONE), ("@ @ ###-##-#### @", NONE), ("ref AB## #### #### ####", NONE), ("code XY## #### #### #### ##", NONE), ("@ AB## #### #### #### @", NONE),
    ("mail me: bob at @ dot com", EMAIL), ("write to @ (at) @ (dot) org", EMAIL), ("email @ [at] @ [dot] net", EMAIL), ("@ @ ann.lee[at]@[dot]com", EMAIL),
    ("we looked at home dot the", NONE), ("@ @ met at noon dot then @", NONE), ("@ stop at line dot and @", NONE),
    ("card 3### ###### ####^", CARD), ("visa 4### #### #### ^", CARD), ("paid with amex 3#############^", CARD),
    ("@ @ 4############~ @", NONE), ("invoice 3############^", NONE), ("@ ##############~ @", NONE), ("order #### #### ####", NONE), ("@ @ ############^ @", NONE), ("isbn 978-#-##-######-^", NONE),
    ("host 2001:0db8:####:####:####:####:####:####", IP), ("@ fe80:0000:####:####:####:####:####:#### @", IP), ("from 2001:db8:##:#:##:###:#:#", IP),
    ("at 1:2:3:4:5:6:7:8 @", NONE), ("@ 0#:1#:2#:3#:4#:5#:0#:1# @", NONE), ("score #:#:#:#:#:#:#:#", NONE),
    ("password=%%%%%%%%%%%%%%%%4f", SECRET), ("token = '%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%4f'", SECRET), ("api_key: &&&&&&&&&&&&&&&&&&&&&&&&&&&&&&g7", SECRET), ("@ secret: &&&&&&&&&&x7 @", SECRET), ("pwd = @%%%%e4", SECRET), ("my password is @&&&&k9", SECRET),
    ("commit %%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%4f", NONE), ("@ @ %%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%4f @", NONE), ("sha1: %%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%4f", NONE), ("id = &&&&&&&&&&g7", NONE), ("@ room-@-##b @", NONE), ("see fig-##a-@-@ below", NONE), ("@ covid-19-@ @", NONE), ("file=@_&&&&x7", NONE),
)
#: The same of other forms, on which thresholds are calibrated.
HELD_OUT = (
    ("ring ###-###-#### today", PHONE), ("telephone (###)###-####", PHONE), ("mobile: ###.###.####", PHONE), ("reach us on ### ### ####", PHONE), ("@ cell ###-###-#### @ @", PHONE), ("call 00###########", PHONE), ("@, (###) ###-####, @", PHONE),
    ("invoice ###-###-####", NONE), ("build ###.###.####", NONE), ("@ @ @ ### ### #### @ @", NONE), ("sku ###-###-####", NONE), ("item 00########## @", NONE), ("@ @ ###-###-#### @ @", NONE), ("@ pages ###.###.#### @", NONE),
    ("my ssn is ###-##-####", ID), ("his social security no: ###-##-####", ID), ("IBAN: FR## #### #### #### #### #### ###", ID), ("passport and account CH## #### #### #### ####", ID),
    ("part ###-##-####", NONE), ("@ ###-##-#### @ @", NONE), ("model EF## #### #### ####", NONE), ("@ @ CD## #### #### #### @", NONE),
    ("reach me: tom at @ dot org", EMAIL), ("contact @ (at) @ (dot) com", EMAIL), ("@ @ eva[at]@[dot]net @", EMAIL),
    ("@ arrived at dawn dot so @", NONE), ("a look at that dot and @", NONE),
    ("credit card 3### ###### ####^", CARD), ("payment by visa 4############^", CARD),
    ("@ @ 5############~ @", NONE), ("order 3############^ @", NONE), ("total ##############~", NONE), ("serial #### #### ####", NONE),
    ("server 2001:0db8:####:####:####:####:####:####", IP), ("login from 2a02:####:####:####:####:####:####:####", IP), ("@ 1#:0#:2#:1#:4#:0#:3#:5# @", NONE), ("ratio #:#:#:#:#:#:#:#", NONE),
    ("passwd: &&&&&&&&&&&&q8", SECRET), ("auth_token=&&&&&&&&&&&&&&&&&&&&&&&&q8", SECRET), ("@ secret = '%%%%%%%%%%%%%%%%%%%%%%a4'", SECRET), ("access_key: &&&&&&&&&&&&&&&&&&Z5", SECRET), ("the password is &&&&&&&&m3", SECRET),
    ("md5: %%%%%%%%%%%%%%%%%%%%%%%%%%%%%%c9", NONE), ("@ @ &&&&&&&&&&&&&&r4 @", NONE), ("version=#a##b##c", NONE), ("@ type-##c-@-@ @", NONE), ("row-&&&&&&&&d6 @", NONE),
)


def training_rows(spark: SparkSession, templates: tuple = TEMPLATES, rows: int = TRAIN_ROWS) -> DataFrame:
    """Generated texts: number, text, kind of what they hold."""
    drawn = lambda seed, i, n: F.pmod(F.xxhash64(F.lit(seed), F.col("id"), i), F.lit(n))
    chosen = F.element_at(F.array(*[F.struct(F.lit(t).alias("t"), F.lit(y).alias("y")) for t, y in templates]), (F.pmod(F.col("id"), F.lit(len(templates))) + 1).cast("int"))
    words = F.array(*[F.lit(w) for w in ("thing", "stone", "and", "river", "house", "green", "often", "paper", "with", "number")])
    signs = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    t = F.split(chosen["t"], "")

    def filled(acc: Column, x: Column, i: Column) -> Column:
        word = F.element_at(words, (drawn(7, i, 10) + 1).cast("int"))
        so_far = digits_of(acc)
        last = F.element_at(F.filter(F.sequence(F.lit(0), F.lit(9)), lambda c: luhn(F.concat(so_far, c.cast("string")))), 1)
        sign = lambda n: F.substring(F.lit(signs), (drawn(9, i, n) + 1).cast("int"), F.lit(1))
        value = F.when(x == "#", drawn(5, i, 10).cast("string")).when(x == "@", word).when(x == "%", sign(16)).when(x == "&", sign(62))
        value = value.when(x == "^", last.cast("string")).when(x == "~", ((last + 1 + drawn(3, i, 8)) % 10).cast("string"))
        return F.concat(acc, F.coalesce(value, x))

    numbered = F.transform(t, lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    text = F.aggregate(numbered, F.lit(""), lambda acc, x: filled(acc, x["x"], x["i"]))
    return spark.range(rows).select("id", text.alias("text"), chosen["y"].alias("kind"))


Tree = float | tuple


def grow(rows: list[tuple[tuple[int, ...], float, float]], depth: int) -> Tree:
    """A regression tree on (features, gradient, hessian): a value, or (feature, limit, at most, above)."""
    g, h = sum(r[1] for r in rows), sum(r[2] for r in rows)
    best, gain = None, 1e-3
    if depth:
        for f in range(len(FEATURES)):
            for limit in sorted({r[0][f] for r in rows})[:-1]:
                gl = hl = 0.0
                for x, a, b in rows:
                    if x[f] <= limit:
                        gl, hl = gl + a, hl + b
                won = gl * gl / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g * g / (h + 1)
                if won > gain:
                    best, gain = (f, limit), won
    if best is None:
        return RATE * g / (h + 1)
    f, limit = best
    return f, limit, grow([r for r in rows if r[0][f] <= limit], depth - 1), grow([r for r in rows if r[0][f] > limit], depth - 1)


def value(tree: Tree, x: tuple[int, ...]) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree


def boost(counts: dict[tuple[int, ...], tuple[int, int]]) -> list[Tree]:
    """Gradient-boosted trees on the logistic loss; counts: rows and positive rows by feature values."""
    sums = dict.fromkeys(counts, 0.0)
    trees = []
    for _ in range(TREES):
        rows = []
        for x, (n, pos) in counts.items():
            p = 1 / (1 + math.exp(-sums[x]))
            rows.append((x, pos - n * p, n * p * (1 - p)))
        trees.append(grow(rows, DEPTH))
        for x in sums:
            sums[x] += value(trees[-1], x)
    return trees


def thresholds(trees: list[Tree], counts: dict[tuple[int, ...], tuple[int, int]]) -> dict[int, float]:
    """For each kind the lowest score from which on at least LEAST_PRECISION of the calibration rows are right."""
    out = {}
    for kind in range(len(KINDS)):
        scored = sorted(((sum(value(t, x) for t in trees), n, pos) for x, (n, pos) in counts.items() if x[0] == kind), reverse=True)
        n = pos = 0
        out[kind] = math.inf
        for k, (score, a, b) in enumerate(scored):
            n, pos = n + a, pos + b
            if pos >= LEAST_PRECISION * n and (k + 1 == len(scored) or scored[k + 1][0] < score):
                out[kind] = score if k + 1 == len(scored) else (score + scored[k + 1][0]) / 2
    return out


def counted(spark: SparkSession, templates: tuple) -> dict[tuple[int, ...], tuple[int, int]]:
    """Of the candidates in generated rows, by feature values: how many there are, and how many are personal."""
    rows = training_rows(spark, templates).select("kind", F.explode(candidates(cleaned(F.col("text")))).alias("x"))
    rows = rows.select((F.col("kind") == F.col("x.k")).cast("int").alias("label"), features(F.col("x")).alias("f"))
    return {tuple(r["f"]): (r["n"], r["pos"]) for r in rows.groupBy("f").agg(F.count("*").alias("n"), F.sum("label").alias("pos")).collect()}


_fitted: list[tuple[list[Tree], dict[int, float]]] = []


def model(spark: SparkSession) -> tuple[list[Tree], dict[int, float]]:
    """Trees fitted on rows of TEMPLATES, thresholds calibrated on rows of HELD_OUT; made once."""
    if not _fitted:
        trees = boost(counted(spark, TEMPLATES))
        _fitted.append((trees, thresholds(trees, counted(spark, HELD_OUT))))
    return _fitted[0]


def score_of(trees: list[Tree], f: Column) -> Column:
    def made(tree: Tree) -> Column:
        if not isinstance(tree, tuple):
            return F.lit(float(tree))
        return F.when(f[FEATURES[tree[0]]] <= tree[1], made(tree[2])).otherwise(made(tree[3]))

    total = F.lit(0.0)
    for tree in trees:
        total = total + made(tree)
    return total


# --- the operator ------------------------------------------------------------------------------------------------


def with_spans(docs: DataFrame) -> DataFrame:
    """docs with __base and __spans: arrays of (k, s, e), by kind and start."""
    trees, limits = model(docs.sparkSession)
    least = F.array(*[F.lit(float(limits[k])) for k in range(len(KINDS))])
    near = LONGEST * (len(MORE) + 1)  # so many candidates on either side hold all that meet one

    def scored(x: Column) -> Column:
        return let(features(x), lambda f: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k"), score_of(trees, f).alias("p")))

    def better(a: Column, b: Column) -> Column:
        return (a["p"] > b["p"]) | ((a["p"] == b["p"]) & ((a["s"] < b["s"]) | ((a["s"] == b["s"]) & ((a["e"] > b["e"]) | ((a["e"] == b["e"]) & (a["k"] < b["k"]))))))

    def meets(a: Column, b: Column) -> Column:
        return (a["s"] < b["e"]) & (b["s"] < a["e"])

    def chosen(all_: Column) -> Column:
        return F.filter(all_, lambda x, i: ~F.exists(F.slice(all_, F.greatest(i - near, F.lit(0)) + 1, F.lit(2 * near + 1)), lambda y: meets(x, y) & better(y, x)))

    plain = lambda x: F.struct(x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e"))
    by_start = lambda spans: F.array_sort(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))))
    text = cleaned(F.col("text"))
    some = text.rlike(r"[0-9@]|(?i)[\[(<\x20]at[\])>\x20]")
    none = F.array().cast(f"array<{_SPAN}>")
    out = docs.withColumn("__text", text)
    out = out.withColumn("__base", F.when(some, base_spans(F.col("__text"))).otherwise(none))
    left = spliced(F.col("__text"), by_start(F.col("__base")), lambda x, fresh, n: F.repeat(F.lit("\u0003"), n))
    out = out.withColumn("__left", F.when(some, left)).withColumn("__more", F.when(some, candidates(F.col("__left"))).otherwise(none))
    out = out.withColumn("__more", F.filter(F.transform("__more", scored), lambda x: x["p"] >= F.get(least, x["k"])))
    out = out.withColumn("__more", let(F.array_sort("__more"), chosen))
    out = out.withColumn("__base", F.transform("__base", plain))
    return out.withColumn("__spans", F.array_sort(F.concat("__base", F.transform("__more", plain)))).drop("__more", "__left", "__text")


def told(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"], x["e"])), ",")


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, the number of base spans of each kind, base_sha256, spans, and the numbers of all spans and of secrets, for
    every row of docs (doc_id, text)."""
    out = with_spans(docs.select("doc_id", "text"))
    of_kind = lambda k: lambda x: x["k"] == k
    counts = [F.size(F.filter("__base", of_kind(k))).cast("long").alias(f"n_{KINDS[k]}") for k in (EMAIL, IP, CARD, PHONE)]
    more = [F.size("__spans").cast("long").alias("n_spans"), F.size(F.filter("__spans", of_kind(SECRET))).cast("long").alias("n_secret")]
    return out.select("doc_id", *counts, F.sha2(told(F.array_sort("__base")), 256).alias("base_sha256"), told(F.col("__spans")).alias("spans"), *more)


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span of text replaced by the name of its kind, as in [EMAIL]; of overlapping ones the first names."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    by_start = F.array_sort(F.transform("__spans", lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"))))
    text = spliced(F.col("text"), by_start, lambda x, fresh, n: F.when(fresh, F.get(names, x["k"])).otherwise(F.lit("")))
    others = [c for c in docs.columns if c != "text"]
    own = docs.select("text", F.struct(F.lit(0).alias("__none"), *others).alias("__row"))  # no name of docs can clash
    return with_spans(own).select(*[text.alias("text") if c == "text" else F.col("__row")[c].alias(c) for c in docs.columns])
