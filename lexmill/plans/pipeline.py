"""Modules run in order over one set of documents, with failures kept apart."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import Profile
from ..operators import concordance, features, lexicon, linkage, passages, terms


@dataclass
class Context:
    docs: DataFrame
    profile: Profile = Profile()
    families: dict[str, list[str]] = field(default_factory=dict)
    query: str = ""


@dataclass
class Module:
    id: str
    run: Callable[[Context], dict[str, DataFrame]]
    min_documents: int = 1


def _tables(c: Context, kind: str = "words") -> DataFrame:
    return features.feature_table(c.docs, kind, 100, c.profile)


BUILTIN = {
    m.id: m
    for m in (
        Module("summary", lambda c: {"summary": lexicon.summary(c.docs, c.profile)}),
        Module("frequency", lambda c: {"top": lexicon.top_per_document(lexicon.counts(lexicon.tokens(c.docs, c.profile)))}),
        Module("collocations", lambda c: {"pairs": lexicon.collocations(c.docs, profile=c.profile)}),
        Module("families", lambda c: {"counts": terms.family_counts(c.docs, c.families, c.profile)}),
        Module("kwic", lambda c: {"hits": concordance.kwic(c.docs, c.query)}),
        Module("stylometry", lambda c: {"pairs": features.pair_distances(_tables(c))}, 2),
        Module("passages", lambda c: {"pairs": passages.similar(c.docs, profile=c.profile)}, 2),
        Module("affinity", lambda c: {"merges": linkage.merges(_tables(c, "content"))}, 3),
    )
}


def static_module(manifest: dict) -> Module:
    """A module that returns its manifest's message; the manifest needs id, label and message."""
    missing = [k for k in ("id", "label", "message") if not manifest.get(k)]
    if missing:
        raise ValueError(f"the manifest lacks {', '.join(missing)}")
    return Module(manifest["id"], lambda c: {"message": c.docs.sparkSession.createDataFrame([(manifest["message"],)], "message string")})


def run_modules(requested: list[str], context: Context, modules: dict[str, Module] | None = None) -> dict[str, dict]:
    """Results by module: status ok, skipped, unknown or error, and row counts or what failed.

    Results are counted here, so that errors show in the module they belong to.
    """
    modules, out, n = BUILTIN | (modules or {}), {}, None
    for name in requested:
        if name not in modules:
            out[name] = {"status": "unknown"}
            continue
        n = context.docs.count() if n is None else n
        if n < modules[name].min_documents:
            out[name] = {"status": "skipped", "message": f"needs {modules[name].min_documents} documents"}
            continue
        try:
            found = modules[name].run(context)
            out[name] = {"status": "ok", "tables": found, "rows": {k: v.agg(F.count("*")).first()[0] for k, v in found.items()}}
        except Exception as e:  # one module's failure leaves the others
            out[name] = {"status": "error", "message": str(e)}
    return out


def run_row(kind: str, ids: list[int], parameters: dict) -> tuple:
    """A row of the log of runs: kind, ids and parameters as JSON."""
    import json

    return kind, json.dumps(ids), json.dumps(parameters, sort_keys=True)
