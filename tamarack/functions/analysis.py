"""Text analysis: tokenizers and token filters as column expressions, and the same on the driver for query terms.

Tokens are an array of strings whose index is the position, or, where filters put several tokens at one position, an
array of (t, p) structs. Only NFKC, stemming, synonyms of several words and filters behind stacked tokens need Python, in
Arrow functions that hold one document's tokens as objects, not a batch's.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import SchemaError
from .stemmer import stem

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = "[\\p{IsAlphabetic}\\p{N}]+"
#: Common English words, long ones first.
ENGLISH = tuple((
    "because himself through between another "
    "should before "
    "could would since while there where these those being which still under other after never their might about "
    "said make take like came same come some here were more have each much such with both well will them from than been then when also into over your this that what want most must they only many very "
    "had did and see the are use all him can who too her for our has was his get got but out you how now way any "
    "be he me we if of an in on do to up or as is at it by my "
    "a "
).split())
STOP_LISTS = {"en": ENGLISH, "english": ENGLISH}
TOKENIZERS = ("default", "unicode", "whitespace")
Tokens = list[tuple[str, int]]


def ascii_lower(s: str) -> str:
    return s.translate(str.maketrans(UPPER, LOWER))


def tokenize(name: str, text: str) -> list[str]:
    if name == "whitespace":
        return text.split()
    if name == "unicode":
        text = unicodedata.normalize("NFKC", text).lower()
        return re.findall(r"[^\W_]+(?:['’.:·][^\W_]+)*", text)
    out, word = [], []
    for c in ascii_lower(text):
        if c.isalnum():
            word.append(c)
        elif word:
            out.append("".join(word))
            word = []
    return out + (["".join(word)] if word else [])


@dataclass(frozen=True)
class Filter:
    kind: str  # lowercase, stopwords, stemmer, synonyms or edge_ngram
    words: tuple[str, ...] = ()
    rules: tuple[tuple[tuple[str, ...], tuple[str, ...]], ...] = ()
    low: int = 1
    high: int = 15

    def apply(self, tokens: Tokens) -> Tokens:
        if self.kind == "lowercase":
            return [(t.lower(), p) for t, p in tokens]
        if self.kind == "stopwords":
            return [x for x in tokens if x[0] not in self.words]
        if self.kind == "stemmer":
            return [(stem(t), p) for t, p in tokens]
        if self.kind == "edge_ngram":
            return [(g, p) for t, p in tokens for g in grams(t, self.low, self.high)]
        out, i, at = [], 0, self.by_first()
        while i < len(tokens):
            rule = next((r for r in at.get(tokens[i][0], ()) if tuple(t for t, _ in tokens[i : i + len(r[0])]) == r[0]), None)
            n = len(rule[0]) if rule else 1
            out += tokens[i : i + n] + [(t, tokens[i][1]) for t in (rule[1] if rule else ())]
            i += n
        return out

    def by_first(self) -> dict[str, list]:
        """The rules of synonyms by their first word, in their order."""
        out: dict[str, list] = {}
        for r in self.rules:
            if r[0]:
                out.setdefault(r[0][0], []).append(r)
        return out


def grams(t: str, low: int, high: int) -> list[str]:
    return [t[:n] for n in range(low, min(high, len(t)) + 1)] or [t]


def renumbered(tokens: Tokens) -> Tokens:
    """Positions without gaps; tokens that shared one still do."""
    rank = {p: i for i, p in enumerate(dict.fromkeys(p for _, p in tokens))}
    return [(t, rank[p]) for t, p in tokens]


@dataclass(frozen=True)
class Analyzer:
    tokenizer: str = "default"
    filters: tuple[Filter, ...] = ()

    @property
    def stacked(self) -> bool:
        """Whether several tokens can share a position."""
        return any(f.kind in ("synonyms", "edge_ngram") for f in self.filters)

    @property
    def needs_python(self) -> bool:
        return self.tokenizer == "unicode" or any(f.kind in ("stemmer", "synonyms") for f in self.filters)

    def run(self, text: str) -> Tokens:
        tokens = [(t, i) for i, t in enumerate(tokenize(self.tokenizer, text))]
        for f in self.filters:
            tokens = f.apply(tokens)
        return renumbered(tokens)

    def terms(self, text: str) -> list[str]:
        return [t for t, _ in self.run(text)]

    def pattern(self, text: str) -> str:
        """The form in which a prefix, wildcard or regular expression meets the terms: one token as it is analyzed, else lowered if words are."""
        got = self.terms(text)
        if len(got) == 1 and not re.search(r"[^\w]", text):
            return got[0]
        lowers = self.tokenizer in ("default", "unicode") or any(f.kind == "lowercase" for f in self.filters)
        return text.lower() if lowers else text

    def column(self, text: Column) -> Column:
        """array<string>, or array<struct<t,p>> where tokens are stacked; empty for null."""
        text = F.coalesce(text, F.lit(""))
        if self.tokenizer == "unicode":
            tokens = _unicode(text)
        elif self.tokenizer == "whitespace":
            tokens = F.filter(F.split(text, "(?U)\\s+"), lambda t: t != "")
        else:
            tokens = F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0))
        stacked = False
        for i, f in enumerate(self.filters):
            if f.kind == "lowercase":
                tokens = F.transform(tokens, F.lower) if not stacked else F.transform(tokens, lambda x: F.struct(F.lower(x["t"]).alias("t"), x["p"].alias("p")))
            elif stacked or f.kind == "synonyms" and any(len(r[0]) > 1 for r in f.rules):
                return _filtered(self.filters[i:], stacked, self.stacked)(tokens)
            elif f.kind == "stopwords":
                tokens = without(tokens, f.words)
            elif f.kind == "stemmer":
                tokens = stems(tokens)
            elif f.kind == "synonyms":
                tokens, stacked = with_synonyms(tokens, f), True
            elif f.kind == "edge_ngram":
                tokens, stacked = edge_grams(tokens, f.low, f.high), True
        return tokens


def without(tokens: Column, words: tuple[str, ...]) -> Column:
    return F.filter(tokens, lambda t: ~t.isin(list(words)))


def with_synonyms(tokens: Column, f: Filter) -> Column:
    """For rules from single words: what a word stands for follows it, at its position."""

    def pieces(t: Column, p: Column) -> Column:
        one = lambda c: F.struct(c.alias("t"), p.alias("p"))
        own = F.array(one(t))
        for first, rules in f.by_first().items():
            own = F.when(t == first, F.array(one(t), *[one(F.lit(x)) for x in rules[0][1]])).otherwise(own)
        return own

    return F.flatten(F.transform(tokens, pieces))


def edge_grams(tokens: Column, low: int, high: int) -> Column:
    def pieces(t: Column, p: Column) -> Column:
        sizes = F.when(F.length(t) < low, F.array(F.length(t))).otherwise(F.sequence(F.lit(low), F.least(F.length(t), F.lit(high))))
        return F.transform(sizes, lambda n: F.struct(F.substring(t, 1, n).alias("t"), p.alias("p")))

    return F.flatten(F.transform(tokens, pieces))


#: Tokens that are Python objects at a time, besides those of one document.
PIECE = 1 << 16


def _lists(per_document, kind: pa.DataType) -> pa.Array:
    """An array of lists from an iterator of lists (null: empty); a piece of them at a time is Python objects."""
    pieces, piece, n = [], [], 0
    for tokens in per_document:
        piece.append(tokens)
        n += len(tokens)
        if n >= PIECE:
            pieces.append(pa.array(piece, kind))
            piece, n = [], 0
    return pa.concat_arrays([*pieces, pa.array(piece, kind)])


@lru_cache(None)
def _arrow():
    """Functions over Arrow batches, made when they are first asked for."""

    @F.arrow_udf("array<string>")
    def unicode(texts: pa.Array) -> pa.Array:
        return _lists((tokenize("unicode", x.as_py()) for x in texts), pa.list_(pa.string()))

    @F.arrow_udf("array<string>")
    def stemmed(tokens: pa.Array) -> pa.Array:
        # Each distinct token of a batch is stemmed once.
        words = tokens.flatten().dictionary_encode()
        each = pa.array([stem(w) for w in words.dictionary.to_pylist()], pa.string())
        offsets = pc.subtract(tokens.offsets, tokens.offsets[0])
        return pa.ListArray.from_arrays(offsets, each.take(words.indices))

    return unicode, stemmed


def _unicode(text: Column) -> Column:
    return _arrow()[0](text)


def stems(tokens: Column) -> Column:
    return _arrow()[1](tokens)


def _filtered(filters: tuple[Filter, ...], stacked: bool, stacks: bool):
    """The filters of an analyzer from one that needs whole documents on."""
    kind = pa.list_(pa.struct([("t", pa.string()), ("p", pa.int32())])) if stacks else pa.list_(pa.string())

    def one(tokens: list) -> list:
        got = [(x["t"], x["p"]) for x in tokens] if stacked else [(t, i) for i, t in enumerate(tokens)]
        for f in filters:
            got = f.apply(got)
        return [{"t": t, "p": p} for t, p in renumbered(got)] if stacks else [t for t, _ in got]

    @F.arrow_udf("array<struct<t:string,p:int>>" if stacks else "array<string>")
    def run(tokens: pa.Array) -> pa.Array:
        return _lists((one(x.as_py()) for x in tokens), kind)

    return run


def search_as_you_type(base: Analyzer, low: int, high: int) -> Analyzer:
    return Analyzer(base.tokenizer, (*base.filters, Filter("edge_ngram", low=low, high=high)))


def parse_filter(spec) -> Filter:
    """A name; {name: options}; {"type": name, ...}; {"name": name, ...}; or {"filter": name, "config": options}."""
    if isinstance(spec, str):
        name, options = spec, None
    elif isinstance(spec, dict) and ("type" in spec or "name" in spec or "filter" in spec):
        key = next(k for k in ("type", "name", "filter") if k in spec)
        name, rest = spec[key], {k: v for k, v in spec.items() if k != key}
        options = rest["config"] if set(rest) == {"config"} else rest
        if isinstance(options, dict) and name in options and len(options) == 1:
            options = options[name]
    elif isinstance(spec, dict) and len(spec) == 1:
        name, options = next(iter(spec.items()))
    else:
        raise SchemaError(f"not a token filter: {spec!r}")
    if name == "lowercase":
        return Filter(name)
    if name == "stopwords":
        words = options if options is not None else "en"
        if isinstance(words, dict):
            words = words.get("words", words.get("list", words.get("stopwords", words.get("language", "en"))))
        if isinstance(words, str):
            if words not in STOP_LISTS:
                raise SchemaError(f"unknown stop-word list {words}")
            words = STOP_LISTS[words]
        return Filter(name, words=tuple(words))
    if name == "stemmer":
        language = options if isinstance(options, str) else (options or {}).get("language", "english")
        if language not in ("en", "english"):
            raise SchemaError(f"no stemmer for {language}")
        return Filter(name)
    if name == "synonyms":
        rules = options.get("rules", options.get("synonyms")) if isinstance(options, dict) else options
        many = lambda x: (x,) if isinstance(x, str) else tuple(x)
        return Filter(name, rules=tuple((many(r["from"]), many(r["to"])) for r in rules or []))
    if name == "edge_ngram":
        o = options or {}
        low, high = o.get("min", o.get("min_gram", 1)), o.get("max", o.get("max_gram", 15))
        if low < 1 or high < low:
            raise SchemaError("edge_ngram needs 1 <= min <= max")
        return Filter(name, low=low, high=high)
    raise SchemaError(f"unknown token filter {name}")


class Registry:
    def __init__(self, definitions: list[dict]) -> None:
        self.analyzers = {t: Analyzer(t) for t in TOKENIZERS}
        for d in definitions:
            name = d["name"]
            if name == "default" or name in self.analyzers and name not in TOKENIZERS:
                raise SchemaError(f"analyzer {name} is there already")
            tokenizer = d.get("tokenizer", "default")
            if tokenizer not in TOKENIZERS:
                raise SchemaError(f"unknown tokenizer {tokenizer}")
            self.analyzers[name] = Analyzer(tokenizer, tuple(parse_filter(f) for f in d.get("filters", d.get("token_filters", []))))

    def get(self, name: str) -> Analyzer:
        if name not in self.analyzers:
            raise SchemaError(f"unknown analyzer {name}")
        return self.analyzers[name]
