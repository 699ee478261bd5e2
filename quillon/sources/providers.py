"""Where a block's probability and flags come from: rules, a table of answers, or a chat-completion service.

Every provider takes blocks with a content column and adds ai_probability (text), flags and summary.
"""

from __future__ import annotations

import json
import threading
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.html import detect_flags
from quillon.functions.reply import parse_reply
from quillon.functions.text import PROMPT_CAP

PARSE_ERROR = "Ошибка парсинга"


def by_rules(blocks: DataFrame, probability: Column | None = None) -> DataFrame:
    """Flags by the built-in rules; the probability is a column's, else 0."""
    p = F.lit("0") if probability is None else probability.cast("string")
    return blocks.withColumns({"ai_probability": p, "flags": detect_flags(F.col("content")), "summary": F.lit("")})


def by_lookup(blocks: DataFrame, replies: DataFrame) -> DataFrame:
    """Answers by md5 of the content (replies: md5, ai_probability, flags, summary); blocks without one score 0."""
    answers = replies.select(F.col("md5").alias("q_md5"), "ai_probability", "flags", "summary").dropDuplicates(["q_md5"])
    j = blocks.withColumn("q_key", F.md5("content")).join(answers, F.col("q_key") == F.col("q_md5"), "left").drop("q_key", "q_md5")
    return j.withColumns({"ai_probability": F.coalesce("ai_probability", F.lit("0")), "flags": F.coalesce("flags", F.array().cast("array<string>")), "summary": F.coalesce("summary", F.lit(""))})


@dataclass(frozen=True)
class Service:
    """A chat-completion endpoint. pause: seconds between calls of one task; detail: characters of an exception to keep."""

    url: str
    key: str
    model: str
    system: str = "You review the markup and text of mails and answer in JSON only."
    question: str = 'How likely is it that a language model wrote this? Answer {"ai_probability": 0-100, "flags": [...], "summary": "..."}.'
    timeout: float = 180.0
    pause: float = 2.0
    detail: int = 50
    options: dict = field(default_factory=lambda: dict(top_p=0.8, temperature=0.1))

    def ask(self, text: str) -> tuple[str | None, str | None]:
        """The answer's text, or what went wrong."""
        body = {"model": self.model, "messages": [dict(role=r, content=c) for r, c in (("system", self.system), ("user", f"{self.question}\n\n{text}"))], **self.options}
        request = urllib.request.Request(self.url, json.dumps(body).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {self.key}"})
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as r:
                if r.status != 200:
                    return None, f"HTTP {r.status}"
                answer = json.load(r)
            first = answer["choices"][0] if "choices" in answer else None
            return (None, PARSE_ERROR) if first is None else (first["message"].get("content"), None)
        except urllib.error.HTTPError as e:
            return None, f"HTTP {e.code}"
        except Exception as e:
            return None, str(e)[: self.detail]


_calls = threading.local()


def _wait(pause: float) -> None:
    """Until pause seconds after this worker's last call."""
    left = getattr(_calls, "last", -1e9) + pause - time.monotonic()
    if left > 0:
        time.sleep(left)


def _called() -> None:
    _calls.last = time.monotonic()


def by_service(contents: DataFrame, service: Service) -> DataFrame:
    """Distinct contents (content) with ai_probability, flags, summary, status; store the result before using it, as calls cost.

    Failures score 0 and stay. Identical contents are asked once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0).to_pylist():
                _wait(service.pause)
                text, wrong = service.ask(content[:PROMPT_CAP] + ("..." if len(content) > PROMPT_CAP else ""))
                _called()
                yield pa.RecordBatch.from_arrays([pa.array([content]), pa.array([text], pa.string()), pa.array([wrong], pa.string())], names=["content", "reply", "wrong"])

    return interpret(contents.select("content").where("content is not null").distinct().mapInArrow(run, "content string, reply string, wrong string"))


def interpret(asked: DataFrame) -> DataFrame:
    """asked (content, and its reply or what went wrong; other columns stay) with ai_probability, flags, summary, status; failures score 0 and say why."""
    reply = F.coalesce("reply", F.lit(""))
    parsed = asked.withColumn("q_r", parse_reply(F.when(F.col("wrong").isNull(), reply).otherwise("")))
    lost = ~reply.rlike(r"(?s)\{.*\}")
    summary = F.coalesce(F.col("wrong"), F.when(lost, F.lit(PARSE_ERROR)), F.col("q_r.summary"))
    rest = [c for c in asked.columns if c not in ("reply", "wrong")]
    return parsed.select(*rest, "q_r.ai_probability", "q_r.flags", summary.alias("summary"), F.coalesce("wrong", F.lit("ok")).alias("status"))
