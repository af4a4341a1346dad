"""Language-model steps: prompts, clients, parsing of replies, and the pipelines that use them."""

from __future__ import annotations

import ast
import difflib
import json
import re
import urllib.request
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trendloom.functions.text import clean_label
from trendloom.functions.vocabulary import ABSTENTIONS
from trendloom.operators.centroids import centroids, first_outliers, gate_threshold, top_k


class Chooser(Protocol):
    """Replies to prompts; has to be picklable."""

    def reply(self, prompts: list[str]) -> list[str]: ...


class FirstCandidate:
    """Offline default: takes the first candidate of a prompt if its similarity reaches a floor, else abstains."""

    def __init__(self, floor: float = 0.0):
        self.floor = floor

    def reply(self, prompts: list[str]) -> list[str]:
        out = []
        for p in prompts:
            m = re.search(r"^- id=(-?\d+) sim=(-?[\d.]+)", p, re.MULTILINE)
            out.append(json.dumps({"topic_id": int(m[1]) if m and float(m[2]) >= self.floor else -1}))
        return out


class HttpChooser:
    """A chat endpoint, then a completion endpoint, at temperature 0; an error is an abstention."""

    def __init__(self, url: str, model: str, timeout: float = 600):
        self.url, self.model, self.timeout = url.rstrip("/"), model, timeout

    def _post(self, path: str, body: dict) -> dict:
        data = json.dumps(body | {"model": self.model, "stream": False, "options": {"temperature": 0}}).encode()
        with urllib.request.urlopen(urllib.request.Request(self.url + path, data, {"Content-Type": "application/json"}), timeout=self.timeout) as r:
            return json.loads(r.read())

    def reply(self, prompts: list[str]) -> list[str]:
        out = []
        for p in prompts:
            try:
                out.append(self._post("/api/chat", {"messages": [{"role": "user", "content": p}]})["message"]["content"])
            except (OSError, ValueError, KeyError):
                try:
                    out.append(self._post("/api/generate", {"prompt": p})["response"])
                except (OSError, ValueError, KeyError):
                    out.append('{"topic_id": -1}')
        return out


def parse_json(text: str) -> object | None:
    """JSON or a Python literal: the whole text, or the first list or object in it."""
    s = re.sub(r"(?i)```(json)?", "", text or "").strip()
    for part in [s, *(m[0] for pattern in (r"\[.*\]", r"\{.*\}") if (m := re.search(pattern, s, re.DOTALL)))]:
        for read in (json.loads, ast.literal_eval):
            try:
                return read(part)
            except (ValueError, SyntaxError, MemoryError, RecursionError):
                continue
    return None


def _tidy(label: str) -> str:
    s = re.sub(r"^\s*\d+\s*[.:)]\s*", "", label.strip())
    s = re.sub(r"(?i)^\s*(topic|label)\s*[:\-]\s*", "", s)
    return re.sub(r"\s+", " ", s.strip(" '\"`")).strip().lower()


def parse_choice(reply: str | None, candidates: list[int], labels: dict[str, int]) -> int:
    """M8: the candidate that a reply names, or -1.

    In this order: a word of abstention anywhere; an object's topic_id, topic or id; -1 among
    the numbers; the only candidate among the numbers; a label as such, as a part, or nearly.
    """
    s = re.sub(r"(?i)```(json)?", "", reply or "").strip()
    if any(a in s.lower() for a in ABSTENTIONS):
        return -1
    inner = re.search(r"\{.*?\}", s, re.DOTALL)
    for part in [s, *([inner[0]] if inner else [])]:
        try:
            said = json.loads(part)
        except ValueError:
            continue
        if isinstance(said, dict):
            value = next((said[k] for k in ("topic_id", "topic", "id") if said.get(k) not in (None, "")), None)
            try:
                picked = int(value)
            except (TypeError, ValueError):
                continue
            if picked == -1 or picked in candidates:
                return picked
    numbers = [int(x) for x in re.findall(r"-?\d+", s)]
    if -1 in numbers:
        return -1
    hits = sorted({n for n in numbers if n in candidates})
    if hits:
        return hits[0] if len(hits) == 1 else -1
    low = _tidy(s)
    if not low:
        return -1
    if low in labels:
        return labels[low] if labels[low] in candidates else -1
    partial = {t for k, t in labels.items() if k and (k in low or low in k)}
    if partial:
        only = next(iter(partial))
        return only if len(partial) == 1 and only in candidates else -1
    near = difflib.get_close_matches(low, [k for k, t in labels.items() if t in candidates and k], n=1, cutoff=0.85)
    return labels[near[0]] if near else -1


def ask(df: DataFrame, prompt: str, chooser: Chooser, out: str = "reply") -> DataFrame:
    """df with the replies to its prompts; each batch is one call, so the client may pool its requests."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(chooser.reply(s.tolist()))

    return df.withColumn(out, run(F.col(prompt)))


def choice_column(reply: Column, candidates: Column, names: Column) -> Column:
    """parse_choice() of columns: candidate ids and their labels, position by position."""

    @F.pandas_udf("int")
    def run(r: pd.Series, c: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([parse_choice(a, [int(x) for x in b], {_tidy(k or ""): int(t) for k, t in zip(m, b, strict=True)}) for a, b, m in zip(r, c, n, strict=True)], dtype="int32")

    return run(reply, candidates, names)


def gate_prompt(text: Column, cards: Column, limit: int = 1200) -> Column:
    """A document and its candidates, one line each."""
    lines = F.transform(cards, lambda c: F.format_string("- id=%d sim=%.6f label=%s", c["topic"], c["sim"], c["label"]))
    return F.concat(F.lit('Which topic fits the document? Answer with {"topic_id": id} or {"topic_id": -1}.\nDocument: '), F.substring(F.coalesce(text, F.lit("")), 1, limit), F.lit("\nTopics:\n"), F.array_join(lines, "\n"))


def llm_gate(docs: DataFrame, topics: DataFrame, chooser: Chooser | None = None, k: int = 5, floor: float = 0.55, gate: tuple[float, float] | None = None, gate_quantile: float | None = None, most: int = 0) -> DataFrame:
    """M7: docs (doc_id, topic, text, embedding) with outliers put to a language model that picks among the nearest topics.

    Candidates are the k nearest centroids over ``floor``; documents without one, protected by
    ``gate`` and ``gate_quantile`` (see reassign()), or after the first ``most`` by doc_id where
    that is above 0, aren't asked, and say so in llm_skip_reason. A None chooser passes all rows
    through. Adds llm_called, llm_skip_reason and assignment_confidence, which rows that aren't
    assigned here keep where docs has it.
    """
    before = F.col("assignment_confidence") if "assignment_confidence" in docs.columns else F.lit(None).cast("double")
    flags = {"llm_called": F.lit(False), "llm_skip_reason": F.lit(""), "assignment_confidence": before}
    if chooser is None:
        return docs.withColumns(flags)
    cents = centroids(docs.where("topic <> -1"), ["topic"]).select("topic", F.col("centroid").alias("embedding"))
    if gate:
        gate = gate_threshold(docs, gate, gate_quantile)
        fine = docs.where(~F.coalesce((F.col("cso_top1_sim") >= gate[0]) & (F.col("entropy") <= gate[1]), F.lit(False)))
    else:
        fine = docs
    near = top_k(first_outliers(fine, most), cents, k).where(F.col("sim") > floor).join(topics.select("topic", "label"), "topic", "left")
    cards = near.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("rank", "topic", "sim", F.coalesce("label", F.lit("")).alias("label")))).alias("cards"))
    safe = F.coalesce((F.col("cso_top1_sim") >= gate[0]) & (F.col("entropy") <= gate[1]), F.lit(False)) if gate else F.lit(False)
    open_ = docs.where((F.col("topic") == -1) & ~safe).select("doc_id", "text").join(cards, "doc_id")
    replies = ask(open_.withColumn("prompt", gate_prompt(F.col("text"), F.col("cards"))), "prompt", chooser)
    picked = replies.select("doc_id", "cards", choice_column(F.col("reply"), F.transform("cards", lambda c: c["topic"]), F.transform("cards", lambda c: c["label"])).alias("pick"))
    sim = F.get(F.transform(F.filter("cards", lambda c: c["topic"] == F.col("pick")), lambda c: c["sim"]), F.lit(0))
    out = docs.join(picked.select("doc_id", "pick", sim.alias("_sim")), "doc_id", "left")
    outlier, called = F.col("topic") == -1, F.col("pick").isNotNull()
    reason = F.when(~outlier | called, "").when(safe, "entropy_gate").otherwise("low_similarity")
    return out.withColumns({
        "llm_called": called, "llm_skip_reason": reason, "assignment_confidence": F.when(called & (F.col("pick") != -1), F.col("_sim")).otherwise(before),
        "topic": F.when(called, F.col("pick")).otherwise(F.col("topic")),
    }).drop("pick", "_sim")


def topic_object(x: object) -> dict | None:
    """Label, description and keywords of an object or string that names a topic."""
    if isinstance(x, str):
        x = {"label": x}
    if not isinstance(x, dict) or not str(x.get("label") or x.get("topic") or x.get("name") or "").strip():
        return None
    kws = x.get("keywords") or ""
    kws = ", ".join(map(str, kws)) if isinstance(kws, list) else str(kws)
    return {"label": str(x.get("label") or x.get("topic") or x.get("name")).strip(), "desc": str(x.get("desc") or x.get("description") or "")[:500], "keywords": kws[:400]}


def taxonomy_text(topics: list[dict], most: int = 12_000) -> str:
    """A line for each topic; the first line that passes ``most`` characters is the last."""
    out, size = [], 0
    for t in topics:
        out.append(f"- {t['label']}: {t['desc']} ({t['keywords']})")
        size += len(out[-1]) + 1
        if size > most:
            break
    return "\n".join(out)


def discover(texts: Iterator[str], ask_one: Callable[[str], str], batch: int = 5, patience: int = 200, most: int = 2000) -> list[dict]:
    """Topics named over batches of texts, until ``patience`` texts bring none or there are ``most``.

    Each reply may list new topics and, for each text of the batch, the topic it belongs to;
    those count towards gen_freq only if there are as many as texts.
    """
    topics: dict[str, dict] = {}
    quiet, held = 0, []

    def flush() -> None:
        nonlocal quiet
        lines = "\n".join(f"{i + 1}. {t}" for i, t in enumerate(held))
        said = parse_json(ask_one(f"Known topics: {'; '.join(t['label'] for t in topics.values())}\nDocuments:\n{lines}"))
        said = said if isinstance(said, dict) else {"topics": said if isinstance(said, list) else []}
        new = [t for t in map(topic_object, said.get("topics") or said.get("new_topics") or []) if t and t["label"].lower() not in topics]
        for t in new:
            topics[t["label"].lower()] = t | {"gen_freq": 0}
        told = said.get("assignments") or []
        if len(told) == len(held):
            for name in told:
                if str(name).lower() in topics:
                    topics[str(name).lower()]["gen_freq"] += 1
        quiet = 0 if new else quiet + len(held)
        held.clear()

    for text in texts:
        held.append(text)
        if len(held) == batch:
            flush()
            if quiet >= patience or len(topics) >= most:
                break
    if held and quiet < patience and len(topics) < most:
        flush()
    return list(topics.values())[:most]


def assign_labels(docs: DataFrame, labels: list[str], chooser: Chooser, retries: int = 5, doc_chars: int = 1200, taxonomy: str | None = None) -> DataFrame:
    """(doc_id, topic_label, quote, status, retries): each text put to a model until its label is known and its quote stands in what it was shown.

    The model sees the first ``doc_chars`` characters, all if that is 0 or less, and ``taxonomy``
    (taxonomy_text()) or the bare labels. The prompts of a batch that are still open go out in
    one call, so that a client may pool its requests.
    """
    known = {name.lower(): name for name in labels}
    listed = taxonomy or "; ".join(labels)
    squeeze = lambda s: re.sub(r"\s+", " ", s or "").strip()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            shown = [(t or "")[:doc_chars] if doc_chars > 0 else t or "" for t in pdf["text"]]
            said = [""] * len(shown)
            rows = [["Outlier", "", "failed", retries] for _ in shown]
            open_ = list(range(len(shown)))
            for tries in range(retries + 1):
                replies = chooser.reply([f"Topics: {listed}\nDocument: {shown[i]}\n{said[i]}" for i in open_]) if open_ else []
                left = []
                for i, reply in zip(open_, replies, strict=True):
                    got = parse_json(reply)
                    name = _tidy(str(got.get("label", ""))) if isinstance(got, dict) else ""
                    quote = str(got.get("quote") or "") if isinstance(got, dict) else ""
                    rows[i][1] = quote
                    if name != "outlier" and name not in known:
                        said[i] = f"'{name}' is not a topic."
                    elif squeeze(quote) not in squeeze(shown[i]):
                        said[i] = "The quote is not in the document."
                    else:
                        rows[i] = [known.get(name, "Outlier"), quote, "ok", tries]
                        continue
                    left.append(i)
                open_ = left
            yield pd.DataFrame([(d, *r) for d, r in zip(pdf["doc_id"], rows, strict=True)], columns=["doc_id", "topic_label", "quote", "status", "retries"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, topic_label string, quote string, status string, retries int")


def label_ids(df: DataFrame, label: str = "topic_label") -> DataFrame:
    """Adds topic: 0, 1 and so on in order of the distinct labels, -1 for Outlier."""
    names = df.select(clean_label(label).alias("_l")).where("_l <> 'Outlier'").distinct()
    ids = names.select("_l", (F.row_number().over(Window.orderBy("_l")) - 1).alias("_i"))  # a row for each label
    return df.withColumn("_l", clean_label(label)).join(ids, "_l", "left").withColumn("topic", F.coalesce("_i", F.lit(-1))).drop("_l", "_i")


def refine_taxonomy(topics: DataFrame, min_freq: int = 2, sim: float = 0.85, most: int = 500) -> DataFrame:
    """Topics (id, label, gen_freq, embedding) of ``min_freq`` or more (all, if none is), those alike joined to one.

    A group's label is that with the highest frequency, ties to the smaller; frequencies add up.
    """
    from trendloom.operators.centroids import near_forest
    from trendloom.operators.components import connected_components

    often = topics.where(F.col("gen_freq") >= min_freq)
    kept = topics if often.isEmpty() else often
    parts = connected_components(near_forest(kept, sim))
    named = kept.join(parts.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    out = named.groupBy("component").agg(F.min(F.struct((-F.col("gen_freq")).alias("m"), "label")).alias("s"), F.sum("gen_freq").alias("gen_freq"), F.count(F.lit(1)).alias("members"))
    return out.select("component", F.col("s.label").alias("label"), "gen_freq", "members").orderBy(F.desc("gen_freq"), "label").limit(most)
