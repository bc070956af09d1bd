"""Models and judges: what answers prompts and what compares answers.

An adapter turns a table of requests into the same table with replies. Four kinds are ready: `recorded` joins stored replies, `rule` computes them by a column
expression, `batched` runs a local model that stays in the workers, and `http` asks a chat endpoint from within the executors, with as many requests at once as are allowed to a run, retries on transient
errors, and credentials from the environment alone. A failure becomes an error text in its row, never a failed job.
"""

from __future__ import annotations

import base64
import http.client
import json
import os
import re
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from email.utils import parsedate_to_datetime
from urllib.error import HTTPError, URLError

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake import workers
from scorelake.functions.text import FILTER_MARK
from scorelake.verdicts import Resumable

#: Status codes of replies that may be others later.
TRANSIENT = {408, 425, 429, 500, 502, 503, 504}
DEFAULT_VIDEO_PROMPT = "Describe this video as fully as you can."
DEFAULT_IMAGE_PROMPT = "Describe what this image shows."


class ReplyError(RuntimeError):
    """A reply that isn't one: its status, its body, and in how many seconds it asks to be tried again, if it does."""

    def __init__(self, status: int, body: str, after: float | None = None):
        super().__init__(f"status {status}: {body}")
        self.status, self.body, self.after = status, body, after


def retry_after(value: str | None, now: float | None = None) -> float | None:
    """Seconds of a Retry-After header: a number, or a date."""
    if not value:
        return None
    if re.match(r"\s*\d+(\.\d+)?\s*\Z", value):
        return float(value)
    try:
        return max(0.0, parsedate_to_datetime(value).timestamp() - (time.time() if now is None else now))
    except (TypeError, ValueError):
        return None


def is_transient(error: BaseException) -> bool:
    """Whether the same request may succeed later: by the reply's status, or because there was none in time."""
    if isinstance(error, ReplyError):
        return error.status in TRANSIENT
    if isinstance(error, HTTPError):
        return error.code in TRANSIENT
    if isinstance(error, URLError):
        return not isinstance(error.reason, BaseException) or is_transient(error.reason)
    return isinstance(error, (TimeoutError, ConnectionError, http.client.HTTPException))


def with_retries(call: Callable[[], str], tries: int = 6, pause: float = 5.0, sleep: Callable[[float], None] = time.sleep, longest: float = 300.0) -> str:
    """call's result; again after a pause for errors that may pass, at most so many times. A reply that says when to come again is taken at its word, up to longest."""
    for n in range(tries):
        try:
            return call()
        except Exception as error:  # noqa: BLE001  whatever a client raises
            if not is_transient(error) or n == tries - 1:
                raise
            sleep(max(pause, min(longest, getattr(error, "after", None) or 0.0)))
    raise AssertionError


class Recorded:
    """Replies of a stored table (key columns and reply). Of a key's several replies the smallest counts."""

    def __init__(self, replies: DataFrame, keys: list[str], reply: str = "reply"):
        self.replies, self.keys = replies.groupBy(*keys).agg(F.min(reply).alias("reply")), keys

    def answer(self, requests: DataFrame, out: str = "reply", prompt: str = "prompt", media: str | None = None, accept: Callable[[str], bool] | None = None) -> DataFrame:
        return requests.join(self.replies.withColumnRenamed("reply", out), self.keys, "left")


class Rule:
    """Replies by a column expression of the requests."""

    def __init__(self, rule: Callable[[DataFrame], Column]):
        self.rule = rule

    def answer(self, requests: DataFrame, out: str = "reply", prompt: str = "prompt", media: str | None = None, accept: Callable[[str], bool] | None = None) -> DataFrame:
        return requests.withColumn(out, self.rule(requests))


@dataclass
class Batched:
    """A local model: make() gives a function from lists of prompts and media to a list of replies. It is made once for each worker process and stays there for its later tasks, under name; a name stands for one
    make (without one, each Batched has its own). It gets batch_size requests at a time, of about equal length, since a batch takes as long as its longest; where it fails on several, they are tried one by one, and
    what fails alone is an error text in its row."""

    make: Callable[[], Callable[[list[str], list], list[str]]]
    batch_size: int = 4
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def answer(self, requests: DataFrame, out: str = "reply", prompt: str = "prompt", media: str | None = None, accept: Callable[[str], bool] | None = None) -> DataFrame:
        """As Http's."""
        name, make, size = self.name, self.make, self.batch_size

        def tell(model, asked: list[tuple[str, object]]) -> list[str]:
            try:
                told = model([p for p, _ in asked], [m for _, m in asked])
                if len(told) != len(asked):
                    raise ValueError(f"{len(told)} replies to {len(asked)} requests")
                return told
            except Exception as error:  # noqa: BLE001
                return [f"[Error: {error}]"] if len(asked) == 1 else [x for one in asked for x in tell(model, [one])]

        def by_length(model, flat: list[tuple[str, object]]) -> list[str]:
            order = sorted(range(len(flat)), key=lambda i: len(flat[i][0] or ""))
            told = [x for at in range(0, len(flat), size) for x in tell(model, [flat[i] for i in order[at : at + size]])]
            out = [""] * len(flat)
            for i, x in zip(order, told, strict=True):
                out[i] = x
            return out

        def replies(asked: Iterator[list[tuple[str, object]]]) -> Iterator[list[str]]:
            for flat in asked:
                model = workers.held(name, make)  # the module's table, not one of this closure
                told = by_length(model, flat)
                poor = [i for i, x in enumerate(told) if accept is not None and not accept(x)]
                for i, x in zip(poor, by_length(model, [flat[i] for i in poor]), strict=True):
                    told[i] = x
                yield told

        return _answered(requests, replies, out, prompt, media)


@dataclass
class Http:
    """A chat endpoint: its URL and key are read from these environment variables of the executors. Of a table's requests at most concurrent are under way at once, however
    many partitions and executors there are: they are dealt to as many lanes, each of which is one partition and asks one after the other."""

    model: str
    url_variable: str = "SCORELAKE_CHAT_URL"
    key_variable: str = "SCORELAKE_CHAT_KEY"
    concurrent: int = 5
    tries: int = 6
    pause: float = 5.0
    timeout: float = 60.0
    temperature: float = 0.0
    max_tokens: int = 1024
    post: Callable[[str, dict, dict, float], dict] | None = None

    def _send(self, prompt: str, media: str | bytes | None) -> str:
        body = {"model": self.model, "messages": [{"role": "user", "content": contents(prompt, media)}], "temperature": self.temperature, "max_tokens": self.max_tokens}
        headers = {"Authorization": f"Bearer {os.environ.get(self.key_variable, '')}"}
        reply = (self.post or _post)(os.environ.get(self.url_variable, ""), body, headers, self.timeout)
        return reply["choices"][0]["message"]["content"]

    def ask(self, prompt: str, media: str | bytes | None = None) -> str:
        try:
            return with_retries(lambda: self._send(prompt, media), self.tries, self.pause)
        except Exception as error:  # noqa: BLE001
            text = str(error)
            return f"{FILTER_MARK}: {text}]" if "content_filter" in text else f"[Error: {text}]"

    def answer(self, requests: DataFrame, out: str = "reply", prompt: str = "prompt", media: str | None = None, accept: Callable[[str], bool] | None = None) -> DataFrame:
        """requests with the replies to a text column, or the replies to an array of texts as an array. media is a column of addresses, or of files' bytes, or of a list of either (frames).
        A reply that accept refuses is asked for once more."""

        def one(prompt: str, media: str | bytes | None) -> str:
            told = self.ask(prompt, media)
            return told if accept is None or accept(told) else self.ask(prompt, media)

        def replies(asked: Iterator[list[tuple[str, object]]]) -> Iterator[list[str]]:
            for flat in asked:
                yield [one(*pm) for pm in flat]

        return _answered(requests.repartition(self.concurrent), replies, out, prompt, media)


def contents(prompt: str, media: str | bytes | list | None) -> list[dict]:
    """A chat message's parts: the text, and each address or, from bytes, each data URI in base64."""
    out: list[dict] = [{"type": "text", "text": prompt}]
    for x in media if isinstance(media, list) else [media] if media else []:
        uri = f"data:image/jpeg;base64,{base64.b64encode(x).decode()}" if isinstance(x, bytes) else x
        out.append({"type": "media", "uri": uri})
    return out


def _answered(requests: DataFrame, replies: Callable[[Iterator[list]], Iterator[list[str]]], out: str, prompt: str, media: str | None) -> DataFrame:
    """requests with a column of replies; replies turns lists of (prompt, media) into lists of texts."""
    many = requests.schema[prompt].dataType.simpleString().startswith("array")
    columns = list(requests.columns)
    at, file_at = columns.index(prompt), columns.index(media) if media else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[pa.RecordBatch, list]] = []

        def asked() -> Iterator[list]:
            for batch in batches:
                prompts = batch.column(at).to_pylist()
                files = batch.column(file_at).to_pylist() if file_at is not None else [None] * len(prompts)
                held.append((batch, prompts))
                yield [(p, m) for x, m in zip(prompts, files, strict=True) for p in (x if many else [x]) or []]

        for told in replies(asked()):
            batch, prompts = held.pop(0)
            each = iter(told)
            own = [[next(each) for _ in x or []] if many else next(each) for x in prompts]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.list_(pa.string()) if many else pa.string())], names=[*columns, out])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema.fields)
    return requests.mapInArrow(run, f"{fields}, `{out}` {'array<string>' if many else 'string'}")


def _post(url: str, body: dict, headers: dict, timeout: float) -> dict:
    from urllib.request import Request, urlopen

    request = Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"} | headers)
    try:
        with urlopen(request, timeout=timeout) as reply:  # noqa: S310
            return json.loads(reply.read())
    except HTTPError as error:
        raise ReplyError(error.code, error.read().decode("utf-8", "replace")[:2000], retry_after(error.headers.get("Retry-After"))) from error


def chat_message(prompt: Column, image: Column | None = None, video: Column | None = None, fps: Column | None = None, frames: Column | None = None) -> Column:
    """struct(role, content): a user's message of an image or a video, with the frames a second to sample or the frames' numbers where they are given, and a text."""
    none = lambda kind: F.lit(None).cast(kind)
    part = lambda kind, text=None, uri=None, fps=None, frames=None: F.struct(F.lit(kind).alias("type"), (none("string") if text is None else text).alias("text"), (none("string") if uri is None else uri).alias("uri"), (none("double") if fps is None else fps.cast("double")).alias("fps"), (none("array<int>") if frames is None else frames).alias("frames"))
    parts = [F.when(uri.isNotNull(), part(kind, None, uri, *extra)) for kind, uri, extra in (("image", image, ()), ("video", video, (fps, frames))) if uri is not None]
    return F.struct(F.lit("user").alias("role"), F.filter(F.array(*parts, part("text", prompt)), lambda x: x.isNotNull()).alias("content"))


def with_prompts(samples: DataFrame) -> DataFrame:
    """samples in which a missing prompt is the default one for their media."""
    default = F.array(F.when(F.col("video_path").isNotNull(), DEFAULT_VIDEO_PROMPT).otherwise(DEFAULT_IMAGE_PROMPT))
    return samples.withColumn("prompt", F.coalesce("prompt", default))


MODELS: dict[str, Callable[[dict], object]] = {}
#: Told apart from what was registered under the same prefix before.
VERSIONS: dict[str, str] = {}


def register_model(prefix: str, make: Callable[[dict], object]) -> None:
    """Models whose name begins with prefix are made by make(config)."""
    MODELS[prefix.lower()] = make
    VERSIONS[prefix.lower()] = uuid.uuid4().hex


def model_for(name: str, config: dict):
    """The adapter of the longest registered prefix of a name. With verdicts, a path, in its settings, its replies are kept there and not asked for again."""
    low = name.lower().replace("_", "-")
    found = max((p for p in MODELS if low.startswith(p)), key=len, default=None)
    if found is None:
        raise KeyError(f"no model is registered for {name!r}; known: {', '.join(sorted(MODELS)) or 'none'}")
    adapter = MODELS[found](config | {"name": name})
    if isinstance(adapter, Batched):  # runs with the same settings share a worker's model
        adapter.name = f"{VERSIONS[found]} {name} {json.dumps(config, sort_keys=True, default=str)}"
    return Resumable(adapter, config["verdicts"], name) if config.get("verdicts") else adapter


register_model("http", lambda c: Http(c.get("model", c["name"])))
register_model("echo", lambda c: Rule(lambda samples: F.transform("prompt", lambda p: F.concat(F.lit("You asked: "), p))))


# ---- judges' prompts, in our own words ----


def ranking_prompt(a: Column, b: Column, task: str) -> Column:
    """A request to compare two responses, and to reply with a JSON verdict."""
    return F.concat(F.lit(f"Two responses to the same task ({task}) follow. Decide which is better.\n\nResponse A:\n"), a, F.lit("\n\nResponse B:\n"), b, F.lit('\n\nReply with JSON alone: {"winner": "A", "B" or "tie", "confidence": 1 to 5, "reason": text, "scores": {"response_a": {criterion: number}, "response_b": {criterion: number}}}'))


def pairwise_prompt(a: Column, b: Column, question: Column, criteria: list[str], template: str | None = None) -> Column:
    """A request to compare two models' responses by criteria. A template of one's own has the places {question}, {response_a}, {response_b} and {criteria}."""
    template = template or 'Question:\n{question}\n\nModel A:\n{response_a}\n\nModel B:\n{response_b}\n\nCompare them by: {criteria}.\n\nReply with JSON alone: {"winner": "Model A", "Model B" or "Tie", "confidence": 0 to 1, "reasoning": text, "criteria_scores": {"model_a": {criterion: number}, "model_b": {criterion: number}}}'
    places = {"{question}": F.coalesce(question, F.lit("")), "{response_a}": F.coalesce(a, F.lit("")), "{response_b}": F.coalesce(b, F.lit("")), "{criteria}": F.lit(", ".join(criteria))}
    return F.concat(*[places.get(x, F.lit(x)) for x in re.split(r"(\{question\}|\{response_a\}|\{response_b\}|\{criteria\})", template) if x])


def score_prompt(a: Column, b: Column) -> Column:
    return F.concat(F.lit("How well does the description cover the reference? Reply with one number from 0 to 1.\n\nDescription:\n"), a, F.lit("\n\nReference:\n"), b)


def events_prompt(text: Column) -> Column:
    return F.concat(F.lit("List the events of this description, at most ten, one short sentence each.\n\n"), text, F.lit('\n\nReply with JSON alone: {"events": [text, ...]}'))


def relations_prompt(events: Column, text: Column) -> Column:
    return F.concat(F.lit("For each event, say whether the description entails it, contradicts it, or leaves it open (neutral).\n\nEvents: "), F.to_json(events), F.lit("\n\nDescription:\n"), text, F.lit('\n\nReply with JSON alone: {"events": [{"event": text, "relationship": "entailment", "neutral" or "contradiction", "reason": text}, ...]}'))
