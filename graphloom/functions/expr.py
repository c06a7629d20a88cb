"""Scalar functions as column expressions: identities, tokens, paths, routes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def lower(x: Column | str) -> Column:
    """Lower case one code point at a time: no final sigma, no dot left over from a capital dotted i."""
    return F.lower(F.replace(F.replace(c(x), F.lit("Σ"), F.lit("σ")), F.lit("İ"), F.lit("i")))


def nfc(x: Column | str) -> Column:
    """Composed form, by the Unicode library that Spark brings; plain ASCII, the common case, passes as it is."""
    composed = F.call_function("reflect", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c(x), F.lit(False))
    return F.when(c(x).rlike(r"[^\x00-\x7f]"), composed).otherwise(c(x))


def slug(x: Column | str) -> Column:
    """Lower-case letters and digits, every other run one ``-``, none at the ends."""
    return F.btrim(F.regexp_replace(lower(nfc(x)), r"[^\p{L}\p{Nd}]+", "-"), F.lit("-"))


def node_id(file: Column | str, label: Column | str) -> Column:
    return F.concat(slug(file), F.lit(":"), slug(label))


def tokenize(x: Column | str) -> Column:
    """Words of an identifier: cut at other characters and between lower case or digit and capital."""
    spaced = F.regexp_replace(nfc(x), "(?<=[a-z0-9])(?=[A-Z])", " ")
    return F.filter(F.split(lower(spaced), r"[^\p{L}\p{Nd}]+"), lambda t: t != "")


def terms(label: Column | str, kind: Column | str) -> Column:
    return F.array_append(tokenize(label), c(kind))


def token_estimate(x: Column | str) -> Column:
    """A fourth of the bytes, at least 1 unless empty."""
    n = F.octet_length(c(x))
    return F.when(n == 0, F.lit(0)).otherwise(F.greatest(F.floor(n / 4).cast("int"), F.lit(1)))


def dir_of(x: Column | str) -> Column:
    return F.regexp_extract(c(x), "^(.*)/[^/]*$", 1)


def dir_label(directory: Column | str) -> Column:
    """Last segment in words, first letter of each raised."""
    words = F.filter(F.split(F.substring_index(c(directory), "/", -1), "[-_]"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), " ")


def import_base(x: Column | str) -> Column:
    return F.substring_index(c(x), "/", -1)


#: Extensions that an import path may carry.
CODE_EXTENSIONS = ["js", "jsx", "mjs", "cjs", "ts", "tsx", "py", "php"]


def last_segment(x: Column | str) -> Column:
    r"""Last part of an import: after ``::``, ``\`` and ``/``, without a code extension, then after the last dot."""
    tail = F.regexp_replace(c(x), r"^.*(?:::|\\|/)", "")
    tail = F.regexp_replace(tail, rf"\.(?:{'|'.join(CODE_EXTENSIONS)})$", "")
    return F.substring_index(tail, ".", -1)


def selector(callee: Column | str) -> Column:
    """Text before the first dot, null for a bare name."""
    return F.when(F.contains(c(callee), F.lit(".")), F.substring_index(c(callee), ".", 1))


def service_of(key: Column | str) -> Column:
    return F.substring_index(c(key), ".", 1)


def key_path(key: Column | str) -> Column:
    """What follows the first blank of an endpoint key."""
    at = F.instr(c(key), " ")
    return F.when(at > 0, F.substr(c(key), at + 1)).otherwise(c(key))


def combine_confidence(a: Column | str, b: Column | str) -> Column:
    return F.when((c(a) == "EXTRACTED") & (c(b) == "EXTRACTED"), F.lit("EXTRACTED")).otherwise(F.lit("INFERRED"))


def norm_path(x: Column | str) -> Column:
    """Route template: no query, parameters and numbers as ``{}``, one leading and no trailing slash."""

    def part(s: Column) -> Column:
        for placeholder in (r"\{[^}]*\}", "<[^>]*>", r":[a-zA-Z_]\w*"):  # braces, angles, a colon with a name
            s = F.regexp_replace(s, placeholder, "{}")
        return F.when(s.rlike("^[0-9]+$"), F.lit("{}")).otherwise(s)

    p = F.array_join(F.transform(F.split(F.regexp_replace(c(x), r"[?#].*$", ""), "/"), part), "/")
    p = F.when(F.startswith(p, F.lit("/")), p).otherwise(F.concat(F.lit("/"), p))
    return F.when(p.rlike("^/+$"), F.lit("/")).otherwise(F.regexp_replace(p, "/+$", ""))


def strip_host(x: Column | str) -> Column:
    """A URL from its path on; what has no scheme stays."""
    rest = F.substr(c(x), F.instr(c(x), "://") + 3)
    path = F.instr(rest, "/")
    return F.when(~F.contains(c(x), F.lit("://")), c(x)).when(path == 0, F.lit("/")).otherwise(F.substr(rest, path))


def http_key(method: Column | str, path: Column | str) -> Column:
    m = F.upper(F.btrim(c(method)))
    return F.concat(F.when(m == "", F.lit("GET")).otherwise(m), F.lit(" "), norm_path(path))


def join_path(prefix: Column | str, path: Column | str) -> Column:
    """Prefix and path with one slash between and in front."""
    parts = F.filter(F.array(F.btrim(c(prefix), F.lit("/")), F.btrim(c(path), F.lit("/"))), lambda p: F.coalesce(p, F.lit("")) != "")
    return F.concat(F.lit("/"), F.array_join(parts, "/"))


def verb(method: Column | str) -> Column:
    m = F.upper(c(method))
    return F.when(m.isin("ALL", "ROUTE"), F.lit("GET")).otherwise(m)


def valid_topic(x: Column | str) -> Column:
    return (c(x) != "") & ~F.startswith(c(x), F.lit("/"))


def exported(x: Column | str) -> Column:
    return c(x).rlike("^[A-Z]")


def short_hash(x: Column | str) -> Column:
    return F.substring(F.sha2(c(x), 256), 1, 12)


def category(kind: Column | str, label: Column | str, file: Column | str) -> Column:
    """0 own code, 1 tests, 2 outside modules."""
    test = c(file).rlike(r"(?:_test\.go|_test\.py|(?:^|/)test_[^/]*\.py|\.(?:test|spec)\.[jt]sx?|Test\.java)$") | c(label).rlike("^Test[A-Z_]?")
    return F.when(c(kind) == "module", F.lit(2)).when(test, F.lit(1)).otherwise(F.lit(0))


def canonical_cycle(members: Column | str) -> Column:
    """A cycle turned so that its smallest member comes first."""
    m, at = c(members), F.array_position(c(members), F.array_min(c(members))).cast("int")
    return F.concat(F.slice(m, at, F.size(m)), F.slice(m, F.lit(1), at - 1))


def format_node(id: Column | str, kind: Column | str, label: Column | str, file: Column | str, line: Column | str) -> Column:
    return F.format_string("%s [%s] %s @ %s:%d", c(id), c(kind), c(label), c(file), c(line))


def format_edge(src: Column | str, dst: Column | str, relation: Column | str, confidence: Column | str) -> Column:
    return F.format_string("%s -%s-> %s (%s)", c(src), c(relation), c(dst), c(confidence))


def html_escape(x: Column | str) -> Column:
    out = c(x)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def extract_all(x: Column | str, pattern: str, group: int = 0) -> Column:
    """All matches of a pattern, or of one of its groups."""
    return F.regexp_extract_all(c(x), F.lit(pattern), F.lit(group))


def json_as(x: Column | str, schema: str) -> Column:
    """A JSON text under a schema, null if it isn't JSON."""
    return F.from_json(c(x), schema)
