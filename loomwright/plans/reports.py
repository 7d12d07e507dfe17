"""Reports in Markdown, the learning curve as SVG, annotation tasks as a JSON array: from figures that are small by nature."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.functions import expr
from loomwright.operators import annotate, profile, sample
from loomwright.schema import ROW_ID, find_label, find_text, values

# Hints for annotators, by a word in the task's name: what a class stands for, and what to do in doubt.
HINTS = {
    "sentiment": {
        "positive": "The writer is pleased: praise, thanks, a recommendation.", "negative": "The writer is displeased: blame, regret, a warning.", "neutral": "Neither pleasure nor displeasure can be told from the words.",
        "?": ["Irony counts by what the writer wants to say, not by the words used.", "Where praise and blame stand side by side, go by the one that the text ends on or dwells on.", "A bare report of facts takes the class that readers would expect of it, unless there is a neutral class."],
    },
    "spam": {
        "spam": "Sent to many to sell, to cheat or to draw clicks.", "ham": "Written for its reader, whatever the subject.", "not spam": "Written for its reader, whatever the subject.",
        "?": ["An offer stays spam even where it could be of use to somebody.", "Automatic notices that sell nothing are no spam."],
    },
    "toxic": {
        "toxic": "Attacks, threatens or demeans a person or a group.", "not toxic": "Attacks nobody, even if the tone is rough.", "non-toxic": "Attacks nobody, even if the tone is rough.",
        "?": ["Words that are cited to be discussed or rejected don't make a text toxic.", "Crude jokes count as toxic only if somebody is their target."],
    },
}


def _now(now: str | None) -> str:
    return now or datetime.now(timezone.utc).isoformat()


def markdown(rows: list[dict], columns: list[str] | None = None) -> str:
    columns = columns or (list(rows[0]) if rows else [])
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    return "\n".join(["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns), *("| " + " | ".join(cell(r.get(c)) for c in columns) + " |" for r in rows)])


def save(path: str, lines: list[str]) -> str:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text("\n".join(lines), encoding="utf-8")
    return path


@dataclass
class Report:
    """A document as data: sections of facts (a dictionary), tables (a list of dictionaries), numbered points (a tuple) and
    text. One renderer serves all reports; sections that have nothing are left out."""

    title: str
    sections: list[tuple[str, object]] = field(default_factory=list)
    now: str | None = None

    def add(self, heading: str, body: object) -> Report:
        if body:
            self.sections.append((heading, body))
        return self

    @staticmethod
    def body(content: object) -> str:
        if isinstance(content, dict):
            return "\n".join(f"- **{k}:** {'N/A' if v is None else v}" for k, v in content.items())
        if isinstance(content, list):
            return markdown(content)
        if isinstance(content, tuple):
            return "\n".join(f"{i}. {x}" for i, x in enumerate(content, 1))
        return str(content)

    def save(self, path: str) -> str:
        parts = [f"# {self.title}", f"Generated: {_now(self.now)}"]
        for heading, content in self.sections:
            parts += [f"{'#' * (2 + heading.startswith('>'))} {heading.removeprefix('>')}", self.body(content)]
        return save(path, ["\n\n".join(parts), ""])


def _hints(task: str) -> dict:
    return next((h for k, h in HINTS.items() if k in task.lower()), {})


def class_definitions(task: str, classes: list[str]) -> dict[str, str]:
    known = _hints(task)
    return {c: known.get(c.lower(), f"Texts that belong to *{c}*.") for c in classes}


def edge_cases(task: str, df: DataFrame, text: str | None) -> list[str]:
    """The task's own, then up to two examples with a confidence below 0.6; if there is neither, two general ones."""
    out = list(_hints(task).get("?", []))
    if text and "confidence" in df.columns and ROW_ID in df.columns:
        doubtful = sample.take(df.where(F.col("confidence") < 0.6), 2).select(expr.preview(F.col(text), 120).alias("t"), "confidence")
        out += [f'"{r["t"]}…" was labelled with confidence={r["confidence"]:.2f} only.' for r in doubtful.collect()]
    return out or ["If no class fits, say so in the remarks and go on.", "One or two words alone may mean anything; look at their source."]


def annotation_spec(df: DataFrame, path: str, task: str = "classification", modality: str = "text") -> str:
    label = find_label(df, ("predicted_label", "label", "target", "class", "category"))
    if label is None:
        raise ValueError("no label column")
    text, classes = find_text(df), annotate.default_classes(df.select(label), label)
    out = Report(f"Annotation Specification: {task}").add("Task", {"Type": task, "Modality": modality, "Classes": len(classes), "Size": f"{df.count()} examples"})
    shown: dict[str, list[str]] = {}
    if text and ROW_ID in df.columns:
        for r in annotate.examples(df.withColumn("text", F.col(text)), label).orderBy("label", "rank").collect():
            shown.setdefault(str(r["label"]), []).append(f'"{r["text"]}"')
    out.sections.append(("Classes", "One section for each."))
    for c, meaning in class_definitions(task, classes).items():
        out.add(f">{c}", "\n\n".join([meaning, Report.body(tuple(shown.get(c, [])))]).rstrip())
    out.add("Edge Cases", tuple(edge_cases(task, df, text)))
    return out.add("Instructions", ("Read a text to its end before you decide.", "Give it one class, the one that fits best.", "Leave a remark where two classes fit equally well.")).save(path)


def quality_report(report: dict, comparison: list[dict], strategy: dict, path: str, now: str | None = None) -> str:
    shares = [{"column": c, **v} for c, v in report["missing"].items()]
    facts = {"Rows": report["shape"]["rows"], "Columns": report["shape"]["columns"], "Duplicates": f"{report['duplicates']['count']} ({report['duplicates']['percent']} %)", "Smallest class over largest": report["imbalance"].get("imbalance_ratio")}
    out = Report("Data Quality", now=now).add("What was found", facts).add(">Missing values", shares).add(">Outliers", report["outliers"])
    return out.add("Repairs", strategy).add("Before and after", comparison).save(path)


def annotation_report(quality: dict, n: int, threshold: float, path: str, method: str = "N/A", now: str | None = None) -> str:
    how = {"Labelled by": method, "Rows": n, "Threshold of confidence": threshold}
    sure = {k.replace("_", " "): v for k, v in quality.items() if k.startswith(("confidence", "low_confidence"))}
    against = {k: quality[k] for k in ("kappa", "agreement") if quality.get(k) is not None}
    classes = [{"class": c, "rows": k} for c, k in (quality.get("label_dist") or {}).items()]
    return Report("Annotation", now=now).add("Run", how).add("Classes", classes).add("Confidence", sure).add("Against known labels", against).save(path)


def _ends(results: dict[str, list[dict]]) -> list[dict]:
    return [{"strategy": s, "labelled": h[-1]["n_labeled"], "accuracy": f"{h[-1]['accuracy']:.4f}", "f1": f"{h[-1]['f1']:.4f}"} for s, h in results.items() if h]


def learning_report(results: dict[str, list[dict]], path: str, now: str | None = None) -> str:
    out = Report("Active Learning", now=now).add("Last round of each strategy", _ends(results))
    if results.get("entropy") and results.get("random"):
        gap = lambda m: f"{results['entropy'][-1][m] - results['random'][-1][m]:+.4f}"
        out.add("Entropy against random", {f"Δ {m}": gap(m) for m in ("accuracy", "f1")})
    for strategy, history in results.items():
        out.add(f">Rounds of {strategy}", history)
    return out.save(path)


def data_card(df: DataFrame, path: str, title: str = "Labelled texts", now: str | None = None) -> str:
    label = "final_label" if "final_label" in df.columns else "label"
    counts = profile.value_counts(df, label).collect()  # a row a class
    n = df.count()
    sources = [str(r[0]) for r in df.select("source").distinct().orderBy("source").collect()] if "source" in df.columns else []
    classes = [{"class": r["value"], "rows": r["count"], "share": f"{round(r['count'] / n * 100, 1) if n else 0.0}%"} for r in counts]
    facts = {"Rows": n, "Classes": ", ".join(sorted(str(r["value"]) for r in counts)), "Sources": ", ".join(sources) or None}
    return Report(f"Data Card: {title}", now=now).add("Overview", facts).add("Classes", classes).add("Columns", {c: t for c, t in df.dtypes if c in values(df)}).save(path)


#: Stages of a run: the figures that the final report has of each, by their names in the run's result.
STAGES = {
    "Data": {"collected": "raw_size", "after cleaning": "clean_size", "labelled": "labeled_size", "labelled by": "annotation_method"},
    "Labels": {"mean confidence": "confidence_mean", "kappa": "kappa", "agreement": "agreement"},
    "Review": {"sent to review": "hitl_total", "corrected": "hitl_corrections"},
    "Model": {"trained on": "train_size", "tested on": "test_size", "accuracy": "accuracy", "f1 macro": "f1_macro", "f1 weighted": "f1_weighted"},
}


def final_report(m: dict, path: str, now: str | None = None) -> str:
    out = Report("Final Report", now=now)
    for stage, figures in STAGES.items():
        out.add(stage, {name: m.get(key) for name, key in figures.items()})
        if stage == "Review":
            out.add(">Some corrections", [e | {"text": f"{(e['text'] or '')[:60]}…", "confidence": f"{e['confidence']:.3f}"} for e in (m.get("hitl_examples") or [])[:10]])
        if stage == "Model":
            out.add(">By class", m.get("classification_report"))
    return out.add("Active learning", _ends(m.get("al_results") or {})).save(path)


def learning_curve(results: dict[str, list[dict]], path: str, title: str = "Learning curves") -> str:
    """Two panels, accuracy and F1 by number of labelled rows, a line for each strategy."""
    colours = ("#1b6ca8", "#c2571a", "#3a7d44", "#7a4fa3")
    points = [h for hs in results.values() for h in hs]
    x0, x1 = min((h["n_labeled"] for h in points), default=0), max((h["n_labeled"] for h in points), default=1)
    out = ['<svg xmlns="http://www.w3.org/2000/svg" width="900" height="380" font-family="sans-serif" font-size="12">', '<rect width="900" height="380" fill="white"/>', f'<text x="450" y="20" text-anchor="middle" font-size="15">{title}</text>']
    for k, measure in enumerate(("accuracy", "f1")):
        left = 60 + 440 * k
        lo, hi = min((h[measure] for h in points), default=0.0), max((h[measure] for h in points), default=1.0)
        at = lambda h, left=left, lo=lo, hi=hi, m=measure: (left + 360 * (h["n_labeled"] - x0) / max(x1 - x0, 1), 320 - 260 * (h[m] - lo) / ((hi - lo) or 1))
        out += [f'<path d="M{left} 50V325H{left + 365}" stroke="#555" fill="none"/>', f'<text x="{left + 180}" y="355" text-anchor="middle">{measure} by labelled rows ({x0} to {x1})</text>', f'<text x="{left - 5}" y="322" text-anchor="end">{lo:.3f}</text>', f'<text x="{left - 5}" y="64" text-anchor="end">{hi:.3f}</text>']
        for i, (strategy, history) in enumerate(results.items()):
            colour = colours[i % len(colours)]
            out.append(f'<polyline fill="none" stroke="{colour}" stroke-width="2" points="{" ".join(f"{x:.1f},{y:.1f}" for x, y in map(at, history))}"/>')
            out.append(f'<text x="{left + 10}" y="{64 + 16 * i}" fill="{colour}">{strategy}</text>')
    return save(path, [*out, "</svg>"])


def export_tasks(df: DataFrame, path: str, array: bool = False) -> str:
    """Annotation tasks as JSON lines, a file from each task of the job; with array, one JSON array for a person's tool,
    written row by row on the driver without holding them."""
    tasks = annotate.tasks(df)
    if not array:
        tasks.select("task").write.mode("overwrite").text(path)
        return path
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    rows = tasks.orderBy(ROW_ID) if ROW_ID in tasks.columns else tasks
    with open(path, "w", encoding="utf-8") as f:
        f.write("[")
        for i, r in enumerate(rows.toLocalIterator()):
            f.write(("," if i else "") + "\n" + r["task"])
        f.write("\n]\n")
    return path
