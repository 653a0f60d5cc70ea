"""Reviews followed as a stream: the rectangles of each review in a map that its events change one by one.

The same eight actions as ``operators.review.review_states`` folds in one go, but a batch touches only
the rectangles it names: the state of a review is a map by rectangle, read and written entry by entry,
and ``carregar`` empties it. Rows come in the order of ``seq`` within a review; one that is not beyond
the last that was applied is a repeat, as after a restart of its source, and changes nothing.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .expiry import with_rocksdb

BOX = "struct<x0: double, y0: double, x1: double, y1: double>"
FIELDS = f"type string, pagina int, bboxes array<{BOX}>, confidence double, context string, requires_review boolean, manual boolean, rejeitada boolean, vista boolean, ajustada boolean"
#: An event; ``carregar`` brings the rectangles of the review, the other actions leave that null.
EVENT = f"seq bigint, acao string, entidade_id string, pagina int, indice int, bbox {BOX}, retangulos array<struct<entidade_id: string, type: string, pagina: int, bboxes: array<{BOX}>, confidence: double, context: string, requires_review: boolean>>"
NAMES = tuple(part.split()[0] for part in FIELDS.replace(BOX, "box").split(", "))


def plain(value):
    """Rows and arrays as JSON has them."""
    if value is None or isinstance(value, (str, bool, int)):
        return value
    if isinstance(value, float):
        return None if value != value else value
    if hasattr(value, "asDict"):
        return {k: plain(v) for k, v in value.asDict().items()}
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    if hasattr(value, "tolist"):
        return plain(value.tolist())
    return [plain(v) for v in value]


class Review(StatefulProcessor):
    """A row for each rectangle that a batch has changed, ``removido`` for one that is there no more."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rectangles = handle.getMapState("rectangles", "entidade_id string", "estado string")
        self.last = handle.getValueState("last", "seq bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = sorted((e for batch in rows for e in batch.to_dict("records")), key=lambda e: e["seq"])
        done = self.last.get()[0] if self.last.exists() else None
        touched: dict[str, dict | None] = {}
        for e in events:
            if done is not None and e["seq"] <= done:
                continue
            done = int(e["seq"])
            touched |= self.applied(e)
        if done is not None:
            self.last.update((done,))
        if touched:
            ids = sorted(touched)
            states = [touched[i] or {} for i in ids]
            yield pd.DataFrame({"doc_id": [key[0]] * len(ids), "entidade_id": ids, "removido": [touched[i] is None for i in ids], **{f: pd.Series([s.get(f) for s in states], dtype=object) for f in NAMES}})

    def applied(self, e: dict) -> dict[str, dict | None]:
        """Changes the map by one event and gives what it has changed."""
        action, own = e["acao"], e["entidade_id"]
        if action == "carregar":
            gone: dict[str, dict | None] = {}
            if self.rectangles.exists():
                gone = {k[0]: None for k in list(self.rectangles.keys())}
                self.rectangles.clear()
            for r in plain(e["retangulos"]) or []:
                name = r.pop("entidade_id")
                gone[name] = self.put(name, r | dict.fromkeys(("manual", "rejeitada", "vista", "ajustada"), False))
            return gone
        if own is None or action in ("selecionar", "definirModo"):
            return {}
        if not self.rectangles.containsKey((own,)):
            if action != "adicionarManual":
                return {}
            new = {"type": "MANUAL", "pagina": int(e["pagina"]), "bboxes": [plain(e["bbox"])], "confidence": None, "context": None, "requires_review": False}
            return {own: self.put(own, new | {"manual": True, "rejeitada": False, "vista": True, "ajustada": False})}
        state = json.loads(self.rectangles.getValue((own,))[0])
        if action == "removerManual" and state["manual"]:
            self.rectangles.removeKey((own,))
            return {own: None}
        if action == "alternarRejeicao":
            return {own: self.put(own, state | {"rejeitada": not state["rejeitada"], "vista": True})}
        if action == "marcarVista":
            return {own: self.put(own, state | {"vista": True})}
        if action == "ajustarBBox":
            boxes = [plain(e["bbox"]) if i == e["indice"] else b for i, b in enumerate(state["bboxes"])]
            return {own: self.put(own, state | {"bboxes": boxes, "vista": True, "ajustada": True})}
        return {}

    def put(self, own: str, state: dict) -> dict:
        self.rectangles.updateValue((own,), (json.dumps(state),))
        return state

    def close(self) -> None:
        pass


def follow_reviews(events: DataFrame) -> DataFrame:
    """The changed rectangles of reviews, as a stream, from a stream of doc_id and ``EVENT``."""
    with_rocksdb(events.sparkSession)
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    output = f"doc_id {dict(events.dtypes)['doc_id']}, entidade_id string, removido boolean, {FIELDS}"
    return events.groupBy("doc_id").transformWithStateInPandas(Review(), output, "Update", "None")
