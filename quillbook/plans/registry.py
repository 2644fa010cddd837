"""Handlers of forms that are added at run time and composed into one batch plan.

A handler is Column builders: what a text scores, what is read from it, which checks its row has to pass and the ledger row it
makes. The plan evaluates only the best handler of a document, in the document's row; there is no branch, scan or union for
each. A handler that can't be analysed is replaced by an error before the plan runs; one that fails while it runs makes
`materialised` run the handlers one by one, so that only its own documents become errors.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from quillbook.functions import text as T
from quillbook.rules import forms
from quillbook.rules.forms import LEDGER_CORE

#: Columns of the ledger that a handler's row may give, with their types; what it doesn't give is null.
FIELDS = {
    "ReturnType": "string", "DocKind": "string", "EntityID": "string", "EntityName": "string", "FY": "string", "PeriodDate": "date", "MonthName": "string", "MonthIndex": "int",
    "PrimaryAmount": "double", "DocRef": "string", "FilingDate": "date",
}


@dataclass(frozen=True)
class Handler:
    """score: a text's upper case to points, 0 for texts that aren't this form; parse: a text to named values; checks: these
    values to (condition, flag); row: these values to ledger columns."""

    name: str
    score: Callable[[Column], Column]
    parse: Callable[[Column], dict[str, Column]]
    checks: Callable[[dict[str, Column]], list[tuple[Column, str]]] = lambda values: []
    row: Callable[[dict[str, Column]], dict[str, Column]] = lambda values: {k: v for k, v in values.items() if k in FIELDS}


class Registry:
    """Handlers by name, in the order in which equal scores are ranked."""

    def __init__(self, handlers: list[Handler] | None = None):
        self._handlers: dict[str, Handler] = {}
        for h in handlers or []:
            self.register(h)

    def register(self, handler: Handler, replace: bool = False) -> None:
        if handler.name in self._handlers and not replace:
            raise ValueError(f"there is a handler {handler.name} already")
        self._handlers[handler.name] = handler

    def unregister(self, name: str) -> None:
        if name not in self._handlers:
            raise ValueError(f"there is no handler {name}")
        del self._handlers[name]

    def names(self) -> list[str]:
        return list(self._handlers)

    def _ledger_row(self, h: Handler) -> Column:
        values = h.parse(F.col("text"))
        given = {"ReturnType": F.lit(h.name), **h.row(values)}
        unknown = sorted(set(given) - set(FIELDS))
        if unknown:
            raise ValueError(f"{h.name} gives columns that the ledger doesn't have: {', '.join(unknown)}")
        flags = T.joined_flags(*[F.when(bad, F.lit(flag)) for bad, flag in h.checks(values)]) if h.checks(values) else F.lit("")
        return F.struct(*[given.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in FIELDS.items()], flags.alias("Flags"))

    def _analysed(self, docs: DataFrame) -> tuple[dict[str, tuple[Column, Column]], dict[str, str]]:
        """(score and row of the handlers that can be planned, why others can't)."""
        good, bad, none = {}, {}, docs.limit(0)
        for h in self._handlers.values():
            try:
                score, row = h.score(F.col("upper_")).cast("int"), self._ledger_row(h)
                none.withColumn("upper_", F.upper("text")).select(score.alias("s"), row.alias("r")).schema  # noqa: B018  asks for the analysis
                good[h.name] = score, row
            except (AnalysisException, ValueError, TypeError, KeyError, AttributeError) as e:
                bad[h.name] = _said(e)
        return good, bad

    def ranked(self, docs: DataFrame) -> DataFrame:
        """Adds handler (null where none is accepted), score and margin, by the classifier's bounds. A handler whose score
        can't be planned takes part in nothing."""
        docs = docs.withColumn("upper_", F.upper(F.coalesce("text", F.lit(""))))
        entries = []
        for k, h in enumerate(self._handlers.values()):
            try:
                score = F.coalesce(h.score(F.col("upper_")).cast("int"), F.lit(0))
                docs.limit(0).select(score).schema  # noqa: B018
            except (AnalysisException, ValueError, TypeError, KeyError, AttributeError):
                continue
            entries.append(F.struct((-score).alias("minus"), F.lit(k).alias("order"), F.lit(h.name).alias("name")))
        if not entries:
            return docs.drop("upper_").withColumns({"handler": F.lit(None).cast("string"), "score": F.lit(0), "margin": F.lit(0)})
        docs = docs.withColumn("ranked_", F.array_sort(F.filter(F.array(*entries), lambda x: x["minus"] < 0)))
        best, second = F.get("ranked_", F.lit(0)), F.get("ranked_", F.lit(1))
        docs = docs.withColumns({"score": F.coalesce(-best["minus"], F.lit(0)), "margin": F.coalesce(-best["minus"], F.lit(0)) - F.coalesce(-second["minus"], F.lit(0)), "handler": best["name"]})
        accepted = (F.col("score") >= forms.ACCEPT_SCORE) & (F.col("margin") >= forms.ACCEPT_MARGIN)
        return docs.withColumn("handler", F.when(accepted, F.col("handler"))).drop("upper_", "ranked_")

    def plan(self, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(ledger rows, errors) of docs (source_file, text), both lazy: rows of accepted documents, errors of the others and
        of those whose handler can't be planned."""
        good, bad = self._analysed(docs)
        return self._rows(self.ranked(docs), good, bad)

    def _rows(self, ranked: DataFrame, good: dict[str, tuple[Column, Column]], bad: dict[str, str]) -> tuple[DataFrame, DataFrame]:
        row = None
        for name, (_, r) in good.items():
            row = F.when(F.col("handler") == name, r) if row is None else row.when(F.col("handler") == name, r)
        reason = F.when(F.col("handler").isNull() & (F.col("score") > 0), "AmbiguousType").when(F.col("handler").isNull(), "UnknownType")
        message = F.lit(None).cast("string")
        for name, why in bad.items():
            reason = reason.when(F.col("handler") == name, "ParserError")
            message = F.when(F.col("handler") == name, F.lit(why)).otherwise(message)
        failed = ranked.withColumns({"Error_Type": reason, "Message": message})
        failed = failed.where("Error_Type is not null").select(F.col("source_file").alias("File"), "Error_Type", "Message")
        if row is None:
            return ranked.where("false").select(*[F.lit(None).cast(FIELDS.get(c, "string")).alias(c) for c in LEDGER_CORE]), failed
        rows = ranked.where(F.col("handler").isin(list(good))).withColumn("row_", row)
        status = F.when(F.col("row_.Flags") != "", "Review").otherwise("OK")
        given = {**{c: F.col(f"row_.{c}") for c in FIELDS}, "Status": status, "Flags": F.col("row_.Flags"), "SourceFile": F.col("source_file")}
        return rows.select(*[given[c].alias(c) for c in LEDGER_CORE]), failed

    def materialised(self, docs: DataFrame, keep: Callable[[DataFrame, str], DataFrame]) -> tuple[DataFrame, DataFrame]:
        """The same, written by keep(frame, name). If the plan fails, each handler's rows are written by themselves, and the
        documents of one that fails become errors with what it said."""
        good, bad = self._analysed(docs)
        ranked = keep(self.ranked(docs), "ranked")
        rows, failed = self._rows(ranked, good, bad)
        try:
            return keep(rows, "rows"), keep(failed, "errors")
        except Exception as e:  # whatever a handler raises on an executor
            if len(good) < 2:
                return keep(self._rows(ranked, {}, dict.fromkeys(good, _said(e)) | bad)[0], "no_rows"), keep(self._rows(ranked, {}, dict.fromkeys(good, _said(e)) | bad)[1], "errors")
        parts = []
        for k, name in enumerate(list(good)):
            try:
                parts.append(keep(self._rows(ranked.where(F.col("handler") == name), {name: good[name]}, {})[0], f"rows_{k}"))
            except Exception as e:
                bad[name] = _said(e)
                del good[name]
        out = self._rows(ranked, {}, {})[0]
        for p in parts:
            out = out.unionByName(p)
        return out, keep(self._rows(ranked, {}, bad)[1], "errors_by_handler")


def _said(e: Exception) -> str:
    """The first line of what an error says, cut as messages are."""
    return (str(e).strip().split("\n") or [""])[0][:300] or type(e).__name__
