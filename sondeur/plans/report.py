"""Reports from an analysis: tables as JSON, a text, an HTML page, a console form. One file's rows come to the driver, the best of its candidates only; `write_json` writes those of all files where they are."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .analyze import Analysis

# Candidates of a text, a page and a console, anomalies of reports and of a console, findings of a console.
TOP, CARDS, SHOWN, ODD, ODD_SHOWN, FOUND_SHOWN = 10, 8, 15, 10, 5, 10


def best(a: Analysis, top: int = TOP, least: int = 2) -> DataFrame:
    return a.ranked.where((F.col("rating") >= least) & (F.col("rank") <= top)).select("path", "rank", "source", "rating", "reason", "entropy", "size", "findings", "preview_hex", "preview_ascii")


def write_json(a: Analysis, folder: str) -> None:
    """Every table but contents of files, a folder each."""
    for name, table in a.tables().items():
        table.drop("trailer", "content").write.mode("overwrite").json(f"{folder}/{name}")


def _rows(table: DataFrame, path: str, *order) -> list:
    return table.where(F.col("path") == path).orderBy(*order).collect() if order else table.where(F.col("path") == path).collect()


def _named(row, *leave) -> list[tuple[str, object]]:
    return [(k, v) for k, v in row.asDict().items() if k not in ("path", *leave)]


def _inside(a: Analysis, path: str) -> list[str]:
    return [r.path for r in a.nested.where(F.startswith(F.col("path"), F.lit(f"{path}!"))).select("path").orderBy("path").collect()]


def sections(a: Analysis, path: str) -> dict[str, list[str]]:
    """Lines by heading, of everything beside the candidates; headings without lines are left out."""
    out = {
        "Signal": [f"{k}: {v}" for r in _rows(a.summary, path) for k, v in _named(r)],
        "Fingerprint": [x for r in _rows(a.fingerprint, path) for x in r.reasons],
        "Findings": [f"[{r.type}] {r.confidence:.1%} by {' > '.join(r.steps)}: {r.value}" for r in _rows(a.findings, path, F.desc("confidence"), "source", "offset")],
        "Recommendations": [r.text for r in _rows(a.recommendations, path, "place")],
        "Modems": [f"[{r.name}] channel {r.ch}: {r.confidence:.1%}" for r in _rows(a.signals, path, F.desc("confidence"), "ch", "name")],
        "Carriers and modulations": [f"{r.kind} {r.name}: {r.value} ({r.confidence:.2f})" for r in _rows(a.sigint.where("kind <> 'finding'"), path, F.desc("confidence"), "kind", "name")],
        "Unusual variance": [f"channel {r.ch}, samples {r.start} to {r.end}: {r.ratio:.2f} times the mean" for r in _rows(a.anomalies, path, "ch", "start")[:ODD]],
        "Nested files": _inside(a, path) + [f"{r.place}, Base64: {bytes(r.value).decode('latin-1')}" for r in _rows(a.base64, path)],
        "Left out": [f"{r.path}: {r.size} bytes" for r in a.left_out.where(F.startswith(F.col("path"), F.lit(f"{path}!"))).collect()],
        "Extraction": [f"{r.extractor}: {r.n} candidates" for r in _rows(a.log, path)],
    }
    return {k: v for k, v in out.items() if v}


def _meta(a: Analysis, path: str) -> list[tuple[str, object]]:
    got = a.meta.where(F.col("path") == path).withColumn("trailer", F.octet_length("trailer")).first()
    return [] if got is None else [(k, v) for k, v in _named(got, "chunks", "metadata") if v is not None]


def text(a: Analysis, path: str) -> str:
    lines = [f"Report on {path}", "", *[f"{k}: {v}" for k, v in _meta(a, path)], "", "Candidates"]
    rows = _rows(best(a), path, "rank")
    for r in rows:
        lines.append(f"{'*' * r.rating:<5} {r.source}: {r.reason} ({r.size} bytes, entropy {r.entropy:.4f})")
        lines += [f"      {f}" for f in r.findings] + [f"      {r.preview_hex[:60]}", f"      {r.preview_ascii[:40]}"]
    if not rows:
        lines.append("none that stands out")
    for heading, more in sections(a, path).items():
        lines += ["", heading, *[f"  {x}" for x in more]]
    return "\n".join(lines) + "\n"


def _curve(values: list[float], width: int = 600, height: int = 80) -> str:
    """Entropy from 0 to 8 as a line."""
    if not values:
        return ""
    step = width / max(1, len(values) - 1)
    points = " ".join(f"{i * step:.1f},{height - height * v / 8:.1f}" for i, v in enumerate(values))
    return f"<h2>Entropy</h2><svg viewBox='0 0 {width} {height}' width='{width}' height='{height}' role='img' aria-label='entropy of windows'><polyline fill='none' stroke='currentColor' points='{points}'/></svg>"


def page(a: Analysis, path: str) -> str:
    safe = lambda x: html.escape(str(x))
    cards = "".join(f"<section><h2>{'&#9733;' * r.rating} {safe(r.source)}</h2><p>{safe(r.reason)}</p>{''.join(f'<p>{safe(f)}</p>' for f in r.findings)}<pre>{safe(r.preview_hex)}\n{safe(r.preview_ascii)}</pre></section>" for r in _rows(best(a, CARDS), path, "rank"))
    about = "".join(f"<tr><th>{safe(k)}</th><td>{safe(v)}</td></tr>" for k, v in _meta(a, path))
    more = "".join(f"<section><h2>{safe(k)}</h2><ul>{''.join(f'<li>{safe(x)}</li>' for x in v)}</ul></section>" for k, v in sections(a, path).items())
    return f"<!doctype html><meta charset=utf-8><title>{safe(path)}</title><h1>{safe(path)}</h1><table>{about}</table>{cards}{_curve([r.entropy for r in _rows(a.entropy, path, 'win')])}{more}"


def document(a: Analysis, path: str) -> str:
    """All rows of one file as JSON, but for contents."""
    pick = lambda t: [json.loads(x) for x in t.where(F.col("path") == path).toJSON().collect()]
    out = {("candidates" if k == "ranked" else k): pick(t.drop("trailer", "value") if k == "base64" else t.drop("trailer")) for k, t in a.tables().items() if k not in ("nested", "left_out")}
    return json.dumps(out | {"nested": _inside(a, path)}, indent=1)


def listed(spark: SparkSession, place: str) -> DataFrame:
    """Sources of the candidates in JSON reports (of `document`)."""
    return spark.read.option("multiLine", True).json(place).select(F.explode("candidates").alias("_c")).select("_c.source")


def _table(title: str, head: list[str], rows: list[list]) -> list[str]:
    cells = [head, *[[str(x) for x in r] for r in rows]]
    width = [max(len(r[i]) for r in cells) for i in range(len(head))]
    return ["", title, *["  ".join(c.ljust(w) for c, w in zip(r, width)).rstrip() for r in cells]] if rows else []


def console(a: Analysis, path: str) -> str:
    """Plain tables of one file for a terminal."""
    lines = _table("File", ["property", "value"], [[k, v] for k, v in _meta(a, path)])
    lines += _table("Signal", ["measure", "value"], [[k, v] for r in _rows(a.summary, path) for k, v in _named(r)])
    lines += _table("Modems", ["kind", "channel", "score"], [[r.name, r.ch, f"{r.confidence:.1%}"] for r in _rows(a.signals, path, F.desc("confidence"), "ch", "name")])
    lines += _table("Unusual variance", ["channel", "start", "end", "length", "ratio"], [[r.ch, r.start, r.end, r.length, f"{r.ratio:.2f}"] for r in _rows(a.anomalies, path, "ch", "start")[:ODD_SHOWN]])
    lines += _table("Candidates", ["rating", "source", "size", "entropy", "reason"], [["*" * r.rating, r.source, r.size, f"{r.entropy:.4f}", r.reason] for r in _rows(best(a, SHOWN), path, "rank")])
    lines += _table("Findings", ["source", "path", "type", "value", "confidence"], [[r.source, " > ".join(r.steps), r.type, r.value, f"{r.confidence:.1%}"] for r in _rows(a.findings, path, F.desc("confidence"), "source", "offset")[:FOUND_SHOWN]])
    lines += [*([""] if lines else []), *[r.text for r in _rows(a.recommendations, path, "place")]]
    return "\n".join(lines).strip("\n") + "\n"
