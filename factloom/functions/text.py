"""String kernels as column expressions: identity rules, identifiers, tokens, paths and rendered texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Words too common to probe decision documents with.
PROBE_STOP_WORDS = (
    "src", "rust", "crates", "lib", "main", "docs", "plans", "research", "readme", "cargo", "toml", "md", "rs", "the", "this",
    "that", "why", "what", "when", "where", "with", "from", "into", "for", "and", "or", "not", "how", "used", "design",
)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ascii_lower(c: Column | str) -> Column:
    """A-Z alone; other letters stay, unlike in lower()."""
    return F.translate(col(c), UPPER, LOWER)


def normalise_path(c: Column | str) -> Column:
    return F.translate(col(c), "\\", "/")


def sanitize_id(c: Column | str) -> Column:
    """ASCII letters and digits in lower case, any other character an underscore."""
    return F.regexp_replace(ascii_lower(c), "[^0-9a-z]", "_")


def symbol_fact_id(language: Column | str, path: Column | str, line: Column | str, kind: Column | str, name: Column | str) -> Column:
    return F.concat_ws("_", F.lit("sym"), sanitize_id(language), sanitize_id(path), col(line).cast("string"), col(kind), sanitize_id(name))


def import_fact_id(language: Column | str, path: Column | str, line: Column | str, kind: Column | str, spec: Column | str) -> Column:
    return F.concat_ws("_", F.lit("imp"), sanitize_id(language), sanitize_id(path), col(line).cast("string"), col(kind), sanitize_id(spec))


def snapshot_id(root: Column | str, revision: Column | str) -> Column:
    return F.concat(col(root), F.lit("::"), F.coalesce(col(revision), F.lit("worktree")))


def snapshot_fingerprint(root: Column | str, revision: Column | str, overlay: Column | str) -> Column:
    return F.concat(snapshot_id(root, revision), F.when(col(overlay), F.lit("::overlay")).otherwise(F.lit("::base")))


def artifact_label(revision: Column | str) -> Column:
    return F.coalesce(F.regexp_replace(col(revision), "[^0-9A-Za-z_-]", "_"), F.lit("worktree"))


def token_set(c: Column | str, least: int) -> Column:
    """Sorted distinct ASCII words of at least that length, in lower case."""
    return F.array_sort(F.array_distinct(F.filter(F.split(ascii_lower(c), "[^0-9a-z]"), lambda t: F.length(t) >= least)))


def query_tokens(c: Column | str) -> Column:
    return token_set(c, 2)


def text_terms(c: Column | str) -> Column:
    return token_set(c, 3)


def normalize_identifier(c: Column | str) -> Column:
    """Words in lower case: a space before each capital, runs of other characters one space."""
    spaced = F.regexp_replace(F.regexp_replace(col(c), "([A-Z])", " $1"), "[^0-9A-Za-z]+", " ")
    return F.trim(ascii_lower(spaced))


def words_of(c: Column | str) -> Column:
    return F.filter(F.split(col(c), r"\s+"), lambda t: t != "")


def identifier_shape(c: Column | str) -> Column:
    """Number of words, lengths of the first four as s (to 3), m (to 6) or l, words beyond these, digits."""
    name = normalize_identifier(c)
    words = words_of(name)
    n = F.size(words)
    pattern = F.array_join(F.transform(F.slice(words, 1, 4), lambda t: F.when(F.length(t) <= 3, "s").when(F.length(t) <= 6, "m").otherwise("l")), "")
    digits = F.length(F.regexp_replace(name, "[^0-9]", ""))
    full = F.format_string("tokens=%d;pattern=%s;extra=%d;digits=%d", n, pattern, F.greatest(n - 4, F.lit(0)), digits)
    return F.when(n == 0, F.lit("tokens=0;pattern=none;digits=0")).otherwise(full)


def identifier_similarity(a: Column | str, b: Column | str) -> Column:
    """Twentieths of shared words among all words, rounded half up."""
    return words_similarity(F.array_distinct(words_of(a)), F.array_distinct(words_of(b)))


def words_similarity(x: Column, y: Column) -> Column:
    """The same for words of which each is there once."""
    both, either = F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))
    score = F.floor((both * 20 + F.floor(either / 2)) / either).cast("int")
    return F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0)).otherwise(score)


def camel_parts(token: Column) -> Column:
    """Parts of an ASCII word, each beginning with a capital but for the first."""
    return F.transform(F.regexp_extract_all(token, F.lit("([A-Z]?[0-9a-z]+|[A-Z])"), F.lit(1)), ascii_lower)


def camel_terms(c: Column | str) -> Column:
    parts = F.flatten(F.transform(F.filter(F.split(col(c), "[^0-9A-Za-z]"), lambda t: t != ""), camel_parts))
    return F.array_sort(F.array_distinct(F.filter(parts, lambda t: (F.length(t) >= 3) & ~t.isin(*PROBE_STOP_WORDS))))


def decision_probe(c: Column | str, most: int = 2) -> Column:
    """What to search decision documents with: the first and last camel-case term, or else the longest words."""
    camel = camel_terms(c)
    terms = F.filter(text_terms(c), lambda t: ~t.isin(*PROBE_STOP_WORDS))
    longest = F.transform(F.array_sort(F.transform(terms, lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t")))), lambda x: x["t"])
    return F.when(F.size(camel) >= 2, F.concat_ws(" ", F.get(camel, F.lit(0)), F.element_at(camel, -1))).otherwise(F.array_join(F.slice(longest, 1, most), " "))


def parent_dir(c: Column | str) -> Column:
    return F.regexp_extract(col(c), "^(.*)/[^/]*$", 1)


def file_name(c: Column | str) -> Column:
    return F.substring_index(col(c), "/", -1)


def file_stem(c: Column | str) -> Column:
    """The last part without its extension; a dot that leads the name belongs to it."""
    return F.regexp_replace(file_name(c), r"(?<=.)\.[^.]*$", "")


def adr_id(c: Column | str) -> Column:
    digits = F.regexp_extract(ascii_lower(c), r"^(?:(?!adr-).)*adr-([0-9]*)", 1)
    return F.when(digits != "", F.concat(F.lit("ADR-"), digits))


def title_from_path(c: Column | str) -> Column:
    return F.coalesce(adr_id(c), F.trim(F.translate(file_stem(c), "_-", "  ")))


def import_leaf(c: Column | str) -> Column:
    """The last part of an import, split at the signs that separate modules; null if empty."""
    parts = F.filter(F.split(col(c), r"[:/.]+"), lambda t: t != "")
    leaf = F.element_at(parts, -1)
    return F.when(F.size(parts) > 0, leaf)


def compact_snippet(c: Column | str, most: int = 160) -> Column:
    text = F.trim(col(c))
    return F.when(F.char_length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def normalize_segments(c: Column | str) -> Column:
    """a/./b/../c as a/c: `.` and empty parts go, `..` takes the part before it away."""
    parts = F.split(col(c), "/")
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, x: F.when((x == "") | (x == "."), acc).when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x))),
    )
    return F.array_join(kept, "/")


def render_check(command: Column | str, directory: Column | str) -> Column:
    text = F.array_join(col(command), " ")
    return F.when(col(directory) == ".", text).otherwise(F.concat(text, F.lit(" (in "), col(directory), F.lit(")")))


def render_target(command: Column | str, directory: Column | str, scope: Column | str) -> Column:
    where = F.when(col(scope) == "", F.lit("<repo>")).otherwise(col(scope))
    return F.concat(render_check(command, directory), F.lit(" [scope:"), where, F.lit("]"))


def receipt_id(kind: str, key: Column | str, suffix: str = "") -> Column:
    return F.concat(F.lit(f"ev_{kind}_"), sanitize_id(key), F.lit(suffix))


def bucket_token_budget(c: Column | str) -> Column:
    return (F.ceil(col(c) / 1024) * 1024).cast("long")


def contains_any(text: Column, words) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | F.contains(text, F.lit(w))
    return found


# --- FNV-1a, 64 bits -----------------------------------------------------------------------------------------------

_SEED_HI, _SEED_LO, _MASK = 0xCBF29CE4, 0x84222325, 0xFFFFFFFF


def fnv1a_sql(c: Column | str) -> Column:
    """The hash of the UTF-8 bytes as 16 hex digits, in SQL alone; for short strings such as ids.

    State: two halves of 32 bits, as a product of 64 would overflow.
    """
    digits = F.hex(F.encode(col(c), "UTF-8"))
    at = F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1)), F.lit(2))
    start = F.struct(F.lit(_SEED_HI).cast("long").alias("hi"), F.lit(_SEED_LO).cast("long").alias("lo"))

    def step(acc: Column, i: Column) -> Column:
        byte = F.conv(F.substring(digits, i, F.lit(2)), 16, 10).cast("long")
        x = acc["lo"].bitwiseXOR(byte)
        low = x * 435
        hi = (acc["hi"] * 435 + F.shiftright(low, 32) + F.shiftleft(x.bitwiseAND(F.lit(0xFFFFFF)), 8)).bitwiseAND(F.lit(_MASK))
        return F.struct(hi.alias("hi"), low.bitwiseAND(F.lit(_MASK)).alias("lo"))

    done = F.when(F.length(digits) == 0, start).otherwise(F.aggregate(at, start, step))
    return F.lower(F.concat(F.lpad(F.hex(done["hi"]), 8, "0"), F.lpad(F.hex(done["lo"]), 8, "0")))


def _fnv(texts: list[bytes]) -> list[str]:
    """All texts side by side, byte by byte, the longest kept on as shorter ones end."""
    order = np.argsort([-len(t) for t in texts], kind="stable")
    sizes = np.array([len(texts[k]) for k in order])
    h = np.full(len(texts), (_SEED_HI << 32) | _SEED_LO, np.uint64)
    whole = np.frombuffer(b"".join(texts[k] for k in order), np.uint8)
    start = np.r_[0, np.cumsum(sizes)[:-1]] if len(sizes) else sizes
    going = len(texts)
    for i in range(int(sizes.max(initial=0))):
        while going and sizes[going - 1] <= i:
            going -= 1
        h[:going] = (h[:going] ^ whole[start[:going] + i]) * np.uint64(0x100000001B3)
    out = [""] * len(texts)
    for k, x in zip(order, h.tolist(), strict=True):
        out[k] = f"{x:016x}"
    return out


@F.arrow_udf(T.StringType())
def fnv1a(texts: pa.Array) -> pa.Array:
    """The same hash for long texts: Arrow batches, all texts of a batch at once."""
    said = texts.cast(pa.binary()).to_pylist()
    found = iter(_fnv([t for t in said if t is not None]))
    return pa.array([None if t is None else next(found) for t in said], pa.string())


# --- paths and outputs in words ------------------------------------------------------------------------------------------


def summarize_paths(paths: Column | str, limit: int) -> Column:
    """The first paths, and how many more there are."""
    paths = col(paths)
    more = F.when(F.size(paths) > limit, F.array(F.concat(F.lit("and "), (F.size(paths) - limit).cast("string"), F.lit(" more")))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(F.slice(paths, 1, limit), more), ", ")


def preview_paths(paths: Column | str, limit: int) -> Column:
    """The same in a listing's words; none for no path."""
    paths = col(paths)
    more = F.when(F.size(paths) > limit, F.array(F.concat(F.lit("... +"), (F.size(paths) - limit).cast("string")))).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(paths) == 0, "none").otherwise(F.array_join(F.concat(F.slice(paths, 1, limit), more), ", "))


def changed_path(root: str, path: Column | str) -> Column:
    """A struct (path, error) for a path as a caller gives it: relative to root, slashes forward, ./ and / taken off; null for
    nothing; an error for one outside root or with a .. in it."""
    base = root.rstrip("/")
    given = F.trim(col(path))
    absolute = F.startswith(given, F.lit("/"))
    inside = (given == base) | F.startswith(given, F.lit(base + "/"))
    relative = F.translate(F.when(absolute, F.substring(given, F.lit(len(base) + 2), F.length(given))).otherwise(given), "\\", "/")
    up = F.array_contains(F.split(relative, "/"), "..")
    plain = F.regexp_replace(F.regexp_replace(F.trim(relative), r"^(?:\./)+", ""), "^/+|/+$", "")
    error = F.when((given != "") & absolute & ~inside, "outside root").when((given != "") & up, "parent traversal")
    return F.struct(F.when(error.isNull() & (plain != ""), plain).alias("path"), error.alias("error"))


def detail_metric(detail: Column | str, prefix: str, whole: bool = False) -> Column:
    """The first segment of a detail text (a; b; c) that is the prefix and a number: the number."""
    number = r"^\+?[0-9]+$" if whole else r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"
    parts = F.transform(F.split(col(detail), ";"), lambda x: F.trim(x))
    values = F.transform(F.filter(parts, lambda x: F.startswith(x, F.lit(prefix))), lambda x: F.substring(x, F.lit(len(prefix) + 1), F.length(x)))
    good = F.filter(values, lambda x: x.rlike(number) & (F.lit(not whole) | (x.try_cast("long") <= 2**32 - 1)))
    return F.get(good, F.lit(0)).try_cast("long" if whole else "double")


def command_output(text: Column | str, most: int = 512) -> Column:
    """What a command said, without white space around it, cut to `most` characters."""
    plain = F.regexp_replace(F.regexp_replace(col(text), "\r\n", "\n"), r"^\s+|\s+$", "")
    return F.when(F.length(plain) > most, F.concat(F.substring(plain, 1, most), F.lit("..."))).otherwise(plain)


def first_line(text: Column | str) -> Column:
    """The first line that is not blank, without white space around it."""
    return F.get(F.filter(F.transform(F.split(col(text), r"\r?\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != ""), F.lit(0))
