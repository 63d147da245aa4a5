"""Identity sidecars, resumable reports, spend texts, error classes and answer events. Inventory 20-23, 34, 47, 157-158, 167-168, 170, 173, 175, 179-180, 183."""

from __future__ import annotations

import html
import json
import os
import re
import time
from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvine.functions.text import stream_pieces
from corvine.operators.filters import FilterError
from corvine.plans.checks import RATES, CostError
from corvine.sources.points import CollectionMismatch

UNBILLED = "stand-in models only, no bill"
HIDDEN_CAUSE = "Something this answer relies on is not working; nothing more is told here."
MARKER = re.compile(r"\[(\d+)\]")


class WrongCollection(LookupError):
    """A request names another collection than the one that is served."""


class ProviderError(RuntimeError):
    """A model behind a seam failed."""


class StoreError(RuntimeError):
    """The points table cannot be used."""


#: error class -> (slug, status, whether the message is about the request and may be shown)
ERRORS: dict[type, tuple[str, int, bool]] = {
    WrongCollection: ("wrong_collection", 404, True), CollectionMismatch: ("collection_mismatch", 409, False),
    StoreError: ("store_unavailable", 503, False), ProviderError: ("provider_unavailable", 503, False),
}


def classify(e: BaseException) -> dict[str, Any]:
    """error_type, status, message and refused=False: a failure is never a refusal."""
    if isinstance(e, FilterError):
        return {"error_type": e.error_type, "status": 422, "message": str(e), "refused": False}
    slug, status, shown = next((v for k, v in ERRORS.items() if isinstance(e, k)), ("internal_error", 500, False))
    return {"error_type": slug, "status": status, "message": str(e) if shown else HIDDEN_CAUSE, "refused": False}


def check_collection(asked: str | None, served: str) -> None:
    if asked and asked != served:
        raise WrongCollection(f"collection {asked!r} is not served; {served!r} is")


def identity_path(root: str, collection: str) -> str:
    return os.path.join(root, f"collection-identity-{re.sub(r'[/\\]', '_', collection)}.json")


def write_identity(path: str, identity: Mapping[str, Any]) -> None:
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(json.dumps(identity, indent=2, sort_keys=True) + "\n")


def read_identity(path: str) -> dict[str, Any] | None:
    if not os.path.isfile(path):
        return None
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    return found if isinstance(found, dict) else None


def resolve_identity(path: str, collection: str, embedder: str, compute: Callable[[], dict[str, Any] | None]) -> dict[str, Any]:
    """The sidecar if there is one, else what ``compute`` makes of the corpus, else only what is known."""
    if (side := read_identity(path)) is not None:
        return {k: side.get(k) for k in ("embedder_id", "chunker_version", "doc_count", "corpus_hash")} | {"collection": side.get("collection") or collection, "source": "sidecar"}
    if (made := compute()) is not None:
        return made | {"source": "computed"}
    return {"embedder_id": embedder, "chunker_version": None, "doc_count": None, "corpus_hash": None, "collection": collection, "source": "missing_corpus"}


class Checkpoint:
    """Results of configurations as they finish; a run goes on only over the same cases in the same order."""

    def __init__(self, path: str, case_ids: Sequence[Any], **about: Any):
        self.path = path
        if os.path.exists(path):
            with open(path, encoding="utf-8") as f:
                self.state = json.load(f)
            if self.state.get("case_ids") != list(case_ids):
                raise ValueError("the checkpoint is of other cases")
        else:
            self.state = {"case_ids": list(case_ids), "configs": {}, **about}

    def run(self, name: str, work: Callable[[], Any]) -> Any:
        if name not in self.state["configs"]:
            self.state["configs"][name] = work()
            write_json(self.path, self.state)
        return self.state["configs"][name]


def write_json(path: str, payload: Any) -> None:
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path + ".new", "w", encoding="utf-8") as f:
        json.dump(payload, f, indent=2, sort_keys=True)
    os.replace(path + ".new", path)


def build_report(case_ids: Sequence[Any], total: int, about: Mapping[str, Any], tier1: Mapping[str, Any] | None = None, tier2: Mapping[str, Any] | None = None) -> dict[str, Any]:
    """Versioned report of the tiers that ran; says whether the figures come from stand-in models only."""
    offline = about.get("embedder", "hash") == "hash" and (tier2 is None or about.get("llm", "fake") == "fake")
    out = {"ok": True, "report_version": 1, "golden_cases": total, "scored_cases": len(case_ids), "offline_defaults": offline, "case_ids": list(case_ids), **about}
    return out | ({"tier1": dict(tier1)} if tier1 else {}) | ({"tier2": dict(tier2)} if tier2 else {})


def preflight(calls: Any, expected: float, bound: float, billed: bool) -> list[str]:
    ops = f"vectors of chunks {calls.document_embeddings}, of questions {calls.query_embeddings}; answers {calls.generations}; judgements {calls.judge_calls}"
    if not billed:
        return [f"Planned spend: 0 USD, {UNBILLED}", f"  work on this machine: {ops}"]
    return ["Planned spend, by assumed USD for a million tokens:", *[f"  {m} {r:.4f}" for m, r in RATES.items()], f"  {ops}", f"  about {expected:.4f} USD, no more than {bound:.4f}"]


def spend_summary(expected: float, bound: float, actual: float, billed: bool) -> str:
    if billed:
        return f"Spent {actual:.6f} USD; planned {expected:.6f}, allowed {bound:.6f}"
    if actual:
        raise CostError(f"a run that nothing was priced for spent ${actual:.6f}")
    return f"Spent 0 USD, {UNBILLED}"


def answer_segments(answer: str, valid: Sequence[int]) -> list[dict[str, Any]]:
    """Text and markers in turn; a marker carries its number only if it stands for a citation."""
    parts = re.split(r"(\[\d+\])", answer)
    return [{"text": p, "marker": int(m[1]) if (m := MARKER.fullmatch(p)) and int(m[1]) in set(valid) else None} for p in parts if p]


def answer_events(answers: DataFrame, key: str, draft: Column, body: Column) -> DataFrame:
    """key, seq, event, data: meta first, a delta for each piece of the draft, one result last."""
    pieces = stream_pieces(draft)
    row = lambda event, data: F.struct(F.lit(event).alias("event"), data.cast("string").alias("data"))
    events = F.concat(
        F.array(row("meta", F.to_json(F.struct(F.col(key).cast("string").alias("request_id"))))),
        F.transform(pieces, lambda p: row("delta", F.to_json(F.struct(p.alias("text"))))), F.array(row("result", body)))
    return answers.select(key, F.posexplode(events).alias("seq", "e")).select(key, "seq", "e.event", "e.data")


def encode_event(event: str, data: Mapping[str, Any]) -> bytes:
    return f"event: {event}\ndata: {json.dumps(dict(data), ensure_ascii=False, separators=(',', ':'))}\n\n".encode()


def render_region(page: str, name: str, values: Mapping[str, Any], template: str) -> str:
    """Replace what stands between the marks of a region; a missing region or value is an error."""
    marks = f"<!-- {name}:start -->", f"<!-- {name}:end -->"
    if any(page.count(m) != 1 for m in marks):
        raise ValueError(f"region {name!r} is not there once")
    head, rest = page.split(marks[0])
    try:
        filled = template.format(**values)
    except (KeyError, IndexError) as e:
        raise ValueError(f"no value for {e}") from e
    return f"{head}{marks[0]}\n{filled}\n{marks[1]}{rest.split(marks[1])[1]}"


def scorecard_html(card: Mapping[str, Any]) -> str:
    names = list(next(iter(card["configs"].values())))
    cells = lambda tag, xs: "".join(f"<{tag}>{html.escape(str(x))}</{tag}>" for x in xs)
    rows = "".join(f"<tr>{cells('td', [c, *[m[n] for n in names]])}</tr>" for c, m in card["configs"].items())
    return f"<table><tr>{cells('th', ['config', *names])}</tr>{rows}</table>"


class Recorder:
    """Spans with their seconds; what goes wrong in recording never stops the work."""

    def __init__(self, spark: SparkSession | None = None):
        self.spark, self.timings_ms, self.failed = spark, {}, []

    @contextmanager
    def span(self, name: str) -> Iterator[None]:
        began = time.perf_counter()
        try:
            if self.spark is not None:
                self.spark.sparkContext.setJobDescription(name)
        except Exception as e:
            self.failed.append(str(e))
        try:
            yield
        finally:
            self.timings_ms[name] = self.timings_ms.get(name, 0.0) + (time.perf_counter() - began) * 1000
            try:
                if self.spark is not None:
                    self.spark.sparkContext.setJobDescription(None)
            except Exception as e:
                self.failed.append(str(e))
