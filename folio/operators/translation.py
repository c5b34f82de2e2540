"""Translation, page by page: what to send, and whether the answer kept its cross-references."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions import patterns as P
from ..functions.text import filled, markup, unfenced
from ..lineage import cut
from .pages import anchor, in_order

#: One page's Markdown and a target language to the translation.
Translator = Callable[[str, str], str]


def translate_pages(pages: DataFrame, make: Callable[[], Translator], target: str = "English") -> DataFrame:
    """page with answer (null: blank page). make() builds the translator once for each task; an empty answer is an error. Write the result before using it twice: a translator is not asked again then."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        translate = make()
        for b in batches:
            rows = b.to_pylist()
            for r in rows:
                r["answer"] = translate(r["body"], target) if r["body"].strip() else None
                if r["answer"] is not None and not r["answer"].strip():
                    raise ValueError(f"page {r['page_no']}: empty translation")
            yield pa.RecordBatch.from_pylist(rows, schema=b.schema.append(pa.field("answer", pa.string())))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema)
    return pages.mapInArrow(run, f"{kinds}, answer string")


class Refused(Exception):
    """The provider's answer to a request that is not asked again, or not any more."""


class HttpTranslator:
    """A translator over a chat completion service. transport: (url, headers, body) to (status, headers, body); so many requests a minute of this one translator (divide a provider's limit by the tasks that run at once). Asked again after 429 and 5xx, up to `retries` times, when the server says or after growing waits."""

    def __init__(self, transport: Callable, url: str, key: str, model: str, prompt: Callable[[str], str], *, per_minute: float = 0, retries: int = 6, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.transport, self.url, self.model, self.prompt, self.retries, self.clock, self.sleep = transport, url, model, prompt, retries, clock, sleep
        self.headers = {"Content-Type": "application/json", "Authorization": f"Bearer {key}"}
        self.gap, self.free_at = 60.0 / per_minute if per_minute else 0.0, 0.0
        self.input_tokens = self.output_tokens = 0

    def _ask(self, body: str) -> str:
        for attempt in range(self.retries + 1):
            if (wait := self.free_at - self.clock()) > 0:
                self.sleep(wait)
            self.free_at = self.clock() + self.gap
            status, headers, answer = self.transport(self.url, self.headers, body)
            if status < 400:
                return answer
            if attempt == self.retries or status != 429 and status < 500:
                raise Refused(f"{status}: {answer[:200]}")
            self.sleep(wait_seconds(attempt, {k.lower(): v for k, v in headers.items()}.get("retry-after")))
        raise AssertionError

    def __call__(self, page: str, target: str) -> str:
        asked = {"model": self.model, "max_tokens": P.MOST_TOKENS, "messages": [{"role": "system", "content": self.prompt(target)}, {"role": "user", "content": page}]}
        try:
            got = json.loads(self._ask(json.dumps(asked)))
            choice = got["choices"][0]
            content = choice["message"]["content"]
        except (ValueError, KeyError, IndexError, TypeError) as e:
            raise Refused(f"not a completion: {e}") from e
        if choice.get("finish_reason") == "length":
            raise Refused("the answer was cut off")
        usage = got.get("usage") or {}
        self.input_tokens += usage.get("prompt_tokens") or 0
        self.output_tokens += usage.get("completion_tokens") or 0
        return content


def wait_seconds(attempt: int, retry_after: str | None) -> float:
    """What the server said (300 at most), else powers of two (120 at most)."""
    try:
        return max(0.0, min(float(retry_after), 300.0))  # type: ignore[arg-type]
    except (TypeError, ValueError):
        return min(2.0**attempt, 120.0)


def translate_document(pages: DataFrame, make: Callable[[], Translator], store: str, target: str = "English", *, at_once: int = 64) -> DataFrame:
    """(doc_id, seq, page_no, body, answer) of all pages from a store (a folder), after those that it lacks have been translated, at_once at a time in order. What is translated is kept whatever fails later; the first failure stops the run, and the next run goes on from there."""
    spark = pages.sparkSession
    columns = pages.select("doc_id", "seq", "page_no", "body")
    schema = T.StructType([*columns.schema.fields, T.StructField("answer", T.StringType())])
    stored = lambda: spark.read.schema(schema).parquet(store)
    spark.createDataFrame([], schema).write.mode("append").parquet(store)
    todo = columns.join(stored().select("doc_id", "seq"), ["doc_id", "seq"], "left_anti").withColumn("__wave", F.floor((F.row_number().over(Window.partitionBy("doc_id").orderBy("seq")) - 1) / at_once))
    todo = cut(todo)
    for wave in range(int(todo.agg(F.max("__wave")).first()[0] or 0) + 1 if not todo.isEmpty() else 0):
        translate_pages(todo.where(F.col("__wave") == wave).drop("__wave"), make, target).select(*schema.names).write.mode("append").parquet(store)
    return stored()


def judged(pages: DataFrame) -> DataFrame:
    """page with answer to page with translated and drift: whether note ids or image targets differ."""
    out = F.when(F.col("answer").isNull(), "").otherwise(unfenced(F.col("answer")))
    p = pages.withColumn("translated", out)
    return p.withColumn("drift", filled(F.col("translated")) & (markup(F.col("body")) != markup(F.col("translated"))))


def rendered(pages: DataFrame, column: str = "translated") -> DataFrame:
    """(doc_id, anchors, text) of pages (doc_id, seq, page_no, anchored, column): anchors only where the source had them; blank pages go."""
    body = F.col(column)
    with_anchor = F.regexp_replace(F.concat(anchor(F.col("page_no")), F.lit("\n\n"), body), r"\s+\z", "")
    shown = F.when(filled(body), F.when(F.col("anchored"), with_anchor).otherwise(body))
    return pages.groupBy("doc_id").agg(in_order(F.col("seq"), shown, "\n\n").alias("text"))


def translation_stats(pages: DataFrame) -> DataFrame:
    done = filled(F.col("translated"))
    return pages.groupBy("doc_id").agg(
        F.count("*").alias("pages"), F.count_if(done).alias("pages_translated"), F.count_if(~filled(F.col("body"))).alias("pages_blank"), F.sum(F.when(done, F.char_length("body")).otherwise(0)).alias("chars_in"),
        F.sum(F.when(done, F.char_length("translated")).otherwise(0)).alias("chars_out"), F.sort_array(F.collect_list(F.when(F.col("drift"), F.col("page_no")))).alias("markup_drift"),
    )


MODELS = "struct<data: array<struct<id: string, active: boolean, input_modalities: array<string>, output_modalities: array<string>, max_completion_tokens: string, max_output_length: string>>>"


def usable_model(m: Column, tokens: int = P.MOST_TOKENS) -> Column:
    """Whether a listed model could translate a page, judged by the fields that are there."""
    text = lambda c: c.isNull() | (F.size(c) == 0) | F.array_contains(c, "text")
    cap = lambda c: F.coalesce(~c.rlike(r"^-?\d+$") | (c.cast("bigint") >= tokens), F.lit(True))
    return (F.coalesce(m["id"], F.lit("")) != "") & F.coalesce(m["active"], F.lit(True)) & text(m["input_modalities"]) & text(m["output_modalities"]) & cap(m["max_completion_tokens"]) & cap(m["max_output_length"])


def listed_models(answers: DataFrame, *, refuse: bool = False) -> DataFrame:
    """(provider, body) of model listings to (provider, models): sorted distinct ids of usable models; null where the answer is no listing, or an error when that row is read (refuse)."""
    data = F.from_json("body", MODELS)["data"]
    models = F.sort_array(F.array_distinct(F.transform(F.filter(data, lambda m: usable_model(m)), lambda m: m["id"])))
    if refuse:
        why = F.concat(F.col("provider"), F.lit(" does not list its models: "), F.substring("body", 1, 200))
        models = F.when(data.isNull(), F.raise_error(why).cast("array<string>")).otherwise(models)
    return answers.select("provider", models.alias("models"))


ANSWER = "struct<choices: array<struct<message: struct<content: string>, finish_reason: string>>, usage: struct<prompt_tokens: bigint, completion_tokens: bigint>>"


def read_answers(answers: DataFrame) -> DataFrame:
    """(…, body) of completions with content, problem (not JSON, shape, truncated, empty; null: none) and the tokens used."""
    a = F.from_json("body", ANSWER)
    r = answers.withColumn("__a", a).withColumn("__c", F.get("__a.choices", F.lit(0)))
    content = F.col("__c.message.content")
    problem = (
        F.when(F.col("__a").isNull() | ~F.ltrim("body").startswith("{"), "not JSON").when(F.col("__c.message").isNull(), "shape")
        .when(F.col("__c.finish_reason") == "length", "truncated").when(~filled(F.coalesce(content, F.lit(""))), "empty")
    )
    return r.select(*answers.columns, content.alias("content"), problem.alias("problem"), F.coalesce("__a.usage.prompt_tokens", F.lit(0)).alias("input_tokens"), F.coalesce("__a.usage.completion_tokens", F.lit(0)).alias("output_tokens"))


def token_usage(answers: DataFrame, key: str) -> DataFrame:
    """(key, answers, refused, input_tokens, output_tokens) of completions (key, body): the tokens of all answers, for those with a problem cost as well."""
    read = read_answers(answers.select(key, "body"))
    return read.groupBy(key).agg(F.count("*").alias("answers"), F.count_if(F.col("problem").isNotNull()).alias("refused"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))
