"""What stands behind vectors, sparse terms, answers and verdicts: protocols of columns, and factories that refuse unknown kinds. Inventory 161-166, 176.

A provider makes columns out of columns, so a model is a pandas UDF behind the same interface, and a run of it is a
projection that Spark schedules. Hosted models need a network, which this engine does not use.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol, runtime_checkable

from pyspark.sql import Column

from corvine.functions import identity
from corvine.functions import text as tx
from corvine.operators import answer

HOSTED = ("openai", "cohere")


class ProviderError(ValueError):
    """A provider is not known, or cannot be used here."""


@runtime_checkable
class Embedder(Protocol):
    model: str
    dim: int

    def vector(self, text: Column) -> Column: ...


@runtime_checkable
class SparseEncoder(Protocol):
    def terms(self, text: Column) -> Column: ...


@runtime_checkable
class Answerer(Protocol):
    """An answer out of context blocks and a question; the sentinel where it abstains."""

    def answer(self, blocks: Column, question: Column) -> Column: ...


@runtime_checkable
class Judge(Protocol):
    def scores(self, question: Column, said: Column, contexts: Column, refused: Column) -> tuple[Column, Column]: ...


@dataclass(frozen=True)
class HashEmbedder:
    dim: int = identity.HASH_DIM
    model: str = identity.HASH_MODEL

    def vector(self, text: Column) -> Column:
        return identity.hash_vector(text, self.dim)


@dataclass(frozen=True)
class TermEncoder:
    stopwords: tuple[str, ...] = tx.SEARCH_STOPWORDS
    lowercase: bool = True

    def terms(self, text: Column) -> Column:
        return tx.search_terms(text, self.stopwords, self.lowercase)


@dataclass(frozen=True)
class ExtractiveAnswerer:
    sentences: int = 2

    def answer(self, blocks: Column, question: Column) -> Column:
        return answer.extractive_answer(blocks, question, self.sentences)


@dataclass(frozen=True)
class OverlapJudge:
    def scores(self, question: Column, said: Column, contexts: Column, refused: Column) -> tuple[Column, Column]:
        return answer.judge(question, said, contexts, refused)


def _made(what: str, kind: str, known: dict[str, Callable], own: object | None, protocol: type):
    """The provider of a kind; ``own`` is one that the caller brings, under the kind "own"."""
    if kind == "own":
        if not isinstance(own, protocol):
            raise ProviderError(f"an own {what} has to have the members of {protocol.__name__}")
        return own
    if kind in HOSTED:
        raise ProviderError(f"{what} {kind!r} is a hosted service, which needs a network; bring one of your own")
    if kind not in known:
        raise ProviderError(f"unknown {what} {kind!r}; known are {', '.join(known)} and own")
    return known[kind]()


def build_embedder(kind: str = "hash", dim: int = identity.HASH_DIM, own: Embedder | None = None) -> Embedder:
    if dim <= 0:
        raise ProviderError("vectors have at least one dimension")
    return _made("embedder", kind, {"hash": lambda: HashEmbedder(dim)}, own, Embedder)


#: Stop-word sets by name.
STOPWORDS = {"english": tx.SEARCH_STOPWORDS, "none": ()}


def build_sparse_encoder(kind: str = "terms", stopwords: str = "english", lowercase: bool = True, own: SparseEncoder | None = None) -> SparseEncoder:
    if stopwords not in STOPWORDS:
        raise ProviderError(f"unknown stop words {stopwords!r}; known are {', '.join(STOPWORDS)}")
    return _made("sparse encoder", kind, {"terms": lambda: TermEncoder(STOPWORDS[stopwords], lowercase)}, own, SparseEncoder)


def build_answerer(kind: str = "extractive", sentences: int = 2, own: Answerer | None = None) -> Answerer:
    return _made("answerer", kind, {"extractive": lambda: ExtractiveAnswerer(sentences)}, own, Answerer)


def build_judge(kind: str = "overlap", own: Judge | None = None) -> Judge | None:
    """None for "none": then nothing is judged."""
    return None if kind == "none" else _made("judge", kind, {"overlap": OverlapJudge}, own, Judge)
