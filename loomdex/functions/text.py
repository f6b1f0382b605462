"""Tokenising, trigrams and size estimates as column expressions (no Python per row)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# written in groups by part of speech; only membership matters
STOP_WORDS = frozenset(
    " ".join(
        [
            "i me my we our you your he him his she her it its they them their who whom which what this that these those",
            "is are was were be been being has have had do does did can could may might shall should will would",
            "the an a some any each every either neither both all few more most other such same own no nor not only just too very",
            "of to in on at by for from with into through during before after above below between than as",
            "and or but if so yet because while when where how",
        ]
    ).split()
)
EXTENSIONS = frozenset("c h cc hh cs go js md py rb rs sh ts cfg cjs cpp css cxx hpp hxx ini jsx log mjs php pyi tsx txt xml yml zig bash html java json toml yaml".split())
CHARS_PER_TOKEN = 3.5

_BREAKS = "[\\s,;:()\\[\\]{}<>\"'`!?#$%^&*+=|\\\\~@]+"
_CAMEL = "(?<=[^A-Z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z]{2}[a-z])"
_FTS = "[^\\p{L}\\p{N}]+"


def _literal(words) -> Column:
    return F.array(*[F.lit(w) for w in sorted(words)])


def split_camel(words: Column) -> Column:
    """Every word cut at its humps: before an upper letter after another kind, and before the last two of an upper run that a lower letter follows."""
    return F.flatten(F.transform(words, lambda w: F.split(w, _CAMEL)))


def _finish(words: Column) -> Column:
    lower = F.transform(split_camel(words), F.lower)
    return F.filter(lower, lambda w: (F.octet_length(w) > 1) & ~F.array_contains(_literal(STOP_WORDS), w))


def tokenize_text(text: Column) -> Column:
    """Tokens of prose, repeats kept: white space and most punctuation split; dots, slashes, dashes and underscores don't."""
    return _finish(F.filter(F.split(F.coalesce(text, F.lit("")), _BREAKS), lambda w: w != ""))


def tokenize_identifier(name: Column) -> Column:
    """Tokens of a path or qualified name; a known file extension at its end is left out."""
    parts = F.filter(F.split(F.coalesce(name, F.lit("")), "::|/|\\."), lambda w: w != "")
    # the lambda keeps the split from being computed once for each use
    cut = F.transform(F.array(parts), lambda p: F.when((F.size(p) > 1) & F.contains(name, F.lit(".")) & F.array_contains(_literal(EXTENSIONS), F.element_at(p, -1)), F.slice(p, 1, F.size(p) - 1)).otherwise(p))
    return _finish(F.filter(F.flatten(F.transform(F.get(cut, 0), lambda w: F.split(w, "[_-]+"))), lambda w: w != ""))


def tokenize_symbol(name: Column, docstring: Column, fqn: Column) -> Column:
    """Tokens that stand for a symbol: its name, its documentation and its qualifiers other than the name."""
    qualifiers = F.filter(F.split(F.coalesce(fqn, F.lit("")), "::"), lambda p: p != F.coalesce(name, F.lit("")))
    return F.concat(tokenize_identifier(name), tokenize_text(docstring), F.flatten(F.transform(qualifiers, tokenize_identifier)))


def fts_terms(text: Column) -> Column:
    """Terms of the full-text index: lower case, cut at everything that is no letter or digit."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), _FTS), lambda w: w != "")


def query_terms(query: str) -> list[str]:
    """The distinct full-text terms of a query, in order."""
    import regex

    return list(dict.fromkeys(t for t in regex.split(r"[^\p{L}\p{N}]+", query.lower()) if t))


def match_expression(query: Column) -> Column:
    """A query as quoted terms joined by OR; empty without terms."""
    terms = F.filter(F.split(F.regexp_replace(query, "[\"*+\\-:^(){}\\[\\]~.,;!?@#$%&=|\\\\/<>'`]", " "), "\\s+"), lambda t: t != "")
    return F.array_join(F.transform(terms, lambda t: F.concat(F.lit('"'), t, F.lit('"'))), " OR ")


def trigrams(text: Column) -> Column:
    """Distinct lower-case character trigrams; none below three characters."""
    low = F.lower(text)
    grams = F.transform(F.sequence(F.lit(1), F.length(low) - 2), lambda i: F.substring(low, i, F.lit(3)))
    return F.when(F.length(low) >= 3, F.array_distinct(grams)).otherwise(F.array().cast("array<string>"))


def identifier_trigrams(name: Column) -> Column:
    """Trigrams of a name and of its parts."""
    return F.array_distinct(F.concat(trigrams(name), F.flatten(F.transform(tokenize_identifier(name), trigrams))))


def jaccard(a: Column, b: Column) -> Column:
    """Share of common members of two sets; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def estimate_tokens(text: Column, chars_per_token: float = CHARS_PER_TOKEN) -> Column:
    """Tokens that a text takes: its bytes by a fixed ratio, rounded up."""
    return tokens_of_bytes(F.octet_length(F.coalesce(text, F.lit(""))), chars_per_token)


def tokens_of_bytes(size: Column, chars_per_token: float = CHARS_PER_TOKEN) -> Column:
    return F.ceil(size / F.lit(chars_per_token))


def dense_cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers; 0 where a length is 0."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    product = lambda x, y: total(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")))
    norm = F.sqrt(product(a, a)) * F.sqrt(product(b, b))
    return F.when(norm > 1.2e-7, product(a, b) / norm).otherwise(F.lit(0.0))


def l2_normalize(vector: Column) -> Column:
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    return F.transform(vector, lambda v: F.when(norm > 0, v / norm).otherwise(v).cast("float"))


def mean_pool(vectors: Column, mask: Column) -> Column:
    """The mean of a text's token vectors (array of arrays) over the tokens whose mask isn't 0; zeros if there are none."""
    kept = F.filter(F.arrays_zip(vectors.alias("v"), mask.alias("m")), lambda x: x["m"] != 0)
    n = F.greatest(F.size(kept), F.lit(1))
    total = lambda i: F.aggregate(kept, F.lit(0.0), lambda s, x: s + F.get(x["v"], i).cast("double"))
    return F.transform(F.sequence(F.lit(0), F.size(F.get(vectors, 0)) - 1), lambda i: (total(i) / n).cast("float"))


#: Characters and tokens of a text beyond which an encoder isn't given more.
EMBEDDING_CHARS, EMBEDDING_TOKENS = 512, 128


def embedding_text(name: Column, signature: Column, docstring: Column) -> Column:
    """What an encoder is given for a symbol: name, signature and the start of its documentation."""
    return F.concat_ws(" ", name, signature, F.substring(docstring, 1, 200))
