"""Scalar text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Function words dropped before lexical search.
STOP_WORDS = "a an and are as at be by for from has he in is it its of on or that the this to was were will with".split()


def query_tokens(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def identifier_tokens(name: Column) -> Column:
    """Words of an identifier: split at `_ / . : - #` and spaces, lower to upper, capitals to a title
    word; lower-cased, two characters at least."""
    spaced = F.regexp_replace(name, r"[_/.:#\s-]+", " ")
    spaced = F.regexp_replace(spaced, r"([a-z0-9])([A-Z])", "$1 $2")
    spaced = F.regexp_replace(spaced, r"([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(F.lower(spaced), " "), lambda w: F.length(w) >= 2)


def without_stop_words(tokens: Column) -> Column:
    return F.filter(tokens, lambda w: ~w.isin(STOP_WORDS))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def overlap(query: Column, tokens: Column) -> Column:
    return F.when(F.size(query) > 0, F.size(F.array_intersect(query, tokens)) / F.size(query)).otherwise(0.0)


def canonical_route(path: Column) -> Column:
    """`:id`, `<id>`, `${x}`, `$x` and `{id}` all become `{id}`."""
    out = F.regexp_replace(path, r"\$\{[^}]*\}", "{id}")
    out = F.regexp_replace(out, r":[A-Za-z_][A-Za-z0-9_]*", "{id}")
    out = F.regexp_replace(out, r"<[^>]*>", "{id}")
    out = F.regexp_replace(out, r"\$[A-Za-z_][A-Za-z0-9_]*", "{id}")
    return F.regexp_replace(out, r"\{[^}]*\}", "{id}")


def under(path: Column, prefix: str) -> Column:
    """Segment-aligned prefix: a/b matches a/b/c, not a/bX."""
    return (path == prefix) | path.startswith(prefix.rstrip("/") + "/")


def reciprocal_rank(rank: Column, k: int = 60) -> Column:
    """(1 / (k + rank + 1)) / (1 / (k + 1))."""
    return (k + 1) / (k + rank + 1)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays, in double precision; null where a norm is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda t, v: t + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)
