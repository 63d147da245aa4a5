"""Content-addressed ids, hash embeddings and vector expressions. Inventory 13, 98, 101, 113-116, 126, 128-129."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from corvine.functions.text import is_ascii, let, normal_path

#: The URL namespace of name-based UUIDs, index mask, default dimension and names.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"
INDEX_MASK = 0x7FFFFFFF
HASH_DIM, HASH_MODEL = 32, "fake-deterministic-v1"


def _bytes(c: Column) -> Column:
    return F.encode(c, "UTF-8")


@F.arrow_udf(StringType())
def _composed(texts: pa.Array) -> pa.Array:
    """Canonical composition, for which there is no built-in; texts that are composed pass as they are."""
    return pa.array([x if x is None or unicodedata.is_normalized("NFC", x) else unicodedata.normalize("NFC", x) for x in texts.to_pylist()], pa.string())


def nfc(c: Column) -> Column:
    """The composed text. ASCII is composed already, so only other texts go to a Python worker."""
    return F.coalesce(_composed(F.when(~is_ascii(c), c)), c)


def sha256_text(c: Column) -> Column:
    """Hex digest of the composed text."""
    return F.sha2(nfc(c), 256)


def _path(path: Column) -> Column:
    return nfc(normal_path(path))


def doc_id(path: Column) -> Column:
    """From the normalised path, so one document has one id however its path is spelt."""
    return F.substring(F.sha2(_path(path), 256), 1, 16)


def chunk_id(doc: Column, index: Column) -> Column:
    return F.format_string("%s:%04d", doc, index)


def uuid5(name: Column, namespace: str = URL_NAMESPACE) -> Column:
    """Name-based UUID of version 5."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), _bytes(name)))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 2), 16, 10).cast("long").bitwiseAND(F.lit(0x3F)).bitwiseOR(F.lit(0x80))))
    parts = [F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 19, 2)), F.substring(h, 21, 12)]
    return F.concat_ws("-", *parts)


def point_id(path: Column, index: Column, content_sha256: Column) -> Column:
    return uuid5(F.concat_ws("::", _path(path), index.cast("string"), content_sha256))


def term_index(term: Column) -> Column:
    """31-bit index of a term: the first four bytes of its SHA-1, without the sign bit."""
    return F.conv(F.substring(F.sha1(_bytes(term)), 1, 8), 16, 10).cast("long").bitwiseAND(F.lit(INDEX_MASK)).cast("int")


def hash_vector(text: Column, dim: int = HASH_DIM) -> Column:
    """Deterministic unit vector of a text: words of SHA-256 digests of a counter and the text, scaled to [-1, 1)."""
    blocks = [F.sha2(F.concat(F.unhex(F.lit(f"{i:08x}")), _bytes(text)), 256) for i in range(-(-dim // 8))]
    words = F.sequence(F.lit(0), F.lit(dim - 1))
    word = lambda digits, i: F.conv(F.substr(digits, i * 8 + 1, F.lit(8)), 16, 10).cast("double") / F.lit(2147483648.0) - 1.0
    return unit(let(F.concat(*blocks), lambda digits: F.transform(words, lambda i: word(digits, i))))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    scaled = lambda w, norm: F.transform(w, lambda x: x / norm)
    return let(v, lambda w: let(F.sqrt(F.aggregate(w, F.lit(0.0), lambda s, x: s + x * x)), lambda norm: scaled(w, norm)))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector is zero."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(F.lit(0.0))


def corpus_hash(documents: DataFrame, path: str = "source_path", text: str = "text") -> DataFrame:
    """(corpus_hash, doc_count): digest of path and text digest of every document in path order.

    Only paths and 64 hex digits per document are gathered; the texts are digested where they lie. The
    digest is sequential by definition, so one row holds the corpus's list of digests.
    """
    rows = documents.select(F.col(path).alias("p"), sha256_text(F.col(text)).alias("h"))
    zero = F.decode(F.unhex(F.lit("00")), "UTF-8")
    ordered = F.array_sort(F.collect_list(F.struct("p", "h")))
    whole = F.array_join(F.transform(ordered, lambda x: F.concat(x["p"], zero, x["h"], zero)), "")
    return rows.agg(F.sha2(whole, 256).alias("corpus_hash"), F.count("*").alias("doc_count"))


def cache_digest(*fields: Column) -> Column:
    return F.sha2(reduce(lambda a, b: F.concat(a, F.lit("\n"), b), fields), 256)
