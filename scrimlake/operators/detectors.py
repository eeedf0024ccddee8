"""Detectors in code: what no pattern can find, for example a model's entities, as spans beside those of patterns."""

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from scrimlake.operators.spans import DEFAULT, SPAN, Pattern, detect


@dataclass(frozen=True)
class Detector:
    """find: of a batch of texts, none of them null, for each its (entity_type, start, end, score), places counting code points.

    load: makes what find needs, a model for example, once in each task; find then gets it as its second argument. Only entity_types are kept.
    """

    name: str
    entity_types: tuple[str, ...]
    find: Callable[..., Sequence[Sequence[tuple[str, int, int, float]]]]
    load: Callable[[], object] | None = None


def code_spans(text: Column, detector: Detector, entities: Sequence[str] | None = None) -> Column:
    """The spans of a detector, batches of texts at a time through Arrow; null texts have none. Spans that don't lie within their text are an error."""
    kept = tuple(t for t in detector.entity_types if entities is None or t in entities)
    find, load, name = detector.find, detector.load, detector.name

    def spans_of(value: str, found) -> list[dict]:
        out = []
        for kind, start, end, score in found:
            if kind in kept:
                if not 0 <= start < end <= len(value):
                    raise ValueError(f"{name} gave the span {start} to {end} of a text of {len(value)} characters")
                out.append({"entity_type": kind, "start": int(start), "end": int(end), "score": float(score), "value": value[start:end]})
        return out

    @F.pandas_udf(f"array<{SPAN}>")
    def made(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        held = (load(),) if load else ()
        for values in batches:
            known = values[values.notna()].tolist()
            found = iter([spans_of(v, f) for v, f in zip(known, find(known, *held), strict=True)])
            yield pd.Series([next(found) if there else [] for there in values.notna()], index=values.index)

    return made(text)


def detect_with(text: Column, detectors: Sequence[Detector] = (), patterns: Sequence[Pattern] = DEFAULT, entities: Sequence[str] | None = None) -> Column:
    """The spans of patterns and of detectors, to be resolved together. A detector none of whose types is asked for isn't in the plan."""
    asked = [d for d in detectors if entities is None or set(entities) & set(d.entity_types)]
    return F.concat(detect(text, patterns, entities), *[code_spans(text, d, entities) for d in asked])
