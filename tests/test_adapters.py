import json
import threading
import time
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorelake import adapters, judged
from scorelake.functions.encoders import encoder_similarity
from scorelake.functions.jsons import readable_verdict
from scorelake.verdicts import Resumable


def logging_make(path):
    """A model that writes a line with its process when it is made, and the prompts of each batch when it is asked."""

    def make():
        import os

        with open(path, "a") as f:
            f.write(f"made {os.getpid()}\n")

        def model(prompts, media):
            with open(path, "a") as f:
                f.write(json.dumps(prompts) + "\n")
            if any("bad" in p for p in prompts):
                raise RuntimeError("no")
            return [p.upper() for p in prompts]

        return model

    return make


def log_of(path):
    lines = path.read_text().splitlines() if path.exists() else []
    return Counter(x for x in lines if x.startswith("made")), [json.loads(x) for x in lines if not x.startswith("made")]


def test_a_model_is_made_once_for_each_worker(spark, tmp_path):
    path = tmp_path / "log"
    adapter = adapters.Batched(logging_make(str(path)), 4)
    frame = spark.range(160).select("id", F.format_string("p%d", "id").alias("prompt")).repartition(16)
    for _ in range(2):
        assert sorted(r.reply for r in adapter.answer(frame).collect()) == sorted(f"P{i}" for i in range(160))
    made, asked = log_of(path)
    assert 1 <= len(made) <= 8 and set(made.values()) == {1} and sum(map(len, asked)) == 320


def test_an_encoder_is_made_once_for_each_worker(spark, tmp_path):
    log = logging_make(str(tmp_path / "log"))

    def make():
        log()
        return lambda texts: np.array([[t.count(c) for c in "0123456789"] for t in texts], float)

    similar = encoder_similarity(make)
    frame = spark.range(160).select(F.col("id").cast("string").alias("a")).repartition(16)
    for _ in range(2):
        assert frame.select(similar(F.col("a"), F.col("a")).alias("s")).agg(F.min("s")).first()[0] == pytest.approx(1)
    made, _ = log_of(tmp_path / "log")
    assert 1 <= len(made) <= 8 and set(made.values()) == {1}


def test_batches_have_about_one_length(spark, tmp_path):
    path = tmp_path / "log"
    prompts = ["x" * (1 + i * 37 % 100) for i in range(40)] + ["bad"]
    frame = spark.createDataFrame(list(enumerate(prompts)), "id long, prompt string").coalesce(1)
    got = {r.id: r.reply for r in adapters.Batched(logging_make(str(path)), 4).answer(frame).collect()}
    assert got == {i: "[Error: no]" if p == "bad" else p.upper() for i, p in enumerate(prompts)} and list(got) == list(range(41))
    full = [b for b in log_of(path)[1] if len(b) == 4 and "bad" not in b]
    assert len(full) >= 9 and all(max(map(len, b)) - min(map(len, b)) <= 12 for b in full)


def test_registered_models_share_by_settings():
    adapters.register_model("lasting", lambda c: adapters.Batched(lambda: None))
    one, same, other = (adapters.model_for("lasting", c).name for c in ({"a": 1}, {"a": 1}, {"a": 2}))
    adapters.register_model("lasting", lambda c: adapters.Batched(lambda: 1))
    assert one == same != other and adapters.model_for("lasting", {"a": 1}).name != one
    del adapters.MODELS["lasting"]


@pytest.fixture
def endpoint():
    """A chat endpoint that counts how many requests are under way, and replies with the prompt in capitals and the number of parts."""
    state = {"now": 0, "most": 0, "all": 0, "busy": set()}
    lock = threading.Lock()

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            parts = body["messages"][0]["content"]
            with lock:
                state["now"], state["all"] = state["now"] + 1, state["all"] + 1
                state["most"] = max(state["most"], state["now"])
                busy = parts[0]["text"].startswith("busy") and parts[0]["text"] not in state["busy"]
                state["busy"].add(parts[0]["text"])
            time.sleep(0.03)
            with lock:
                state["now"] -= 1
            self.send_response(429 if busy else 200)
            if busy:
                self.send_header("Retry-After", "1")
            self.end_headers()
            self.wfile.write(json.dumps({"choices": [{"message": {"content": f"{parts[0]['text'].upper()} {len(parts)}"}}]}).encode())

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    state["url"] = f"http://127.0.0.1:{server.server_port}/"
    yield state
    server.shutdown()


def test_one_budget_of_requests(spark, endpoint):
    url = endpoint["url"]
    post = lambda _, body, headers, timeout: adapters._post(url, body, headers, timeout)
    frame = spark.range(96).select("id", F.format_string("p%d", "id").alias("prompt")).repartition(16)
    for lanes in (3, 1):
        endpoint["most"] = 0
        got = adapters.Http("m", concurrent=lanes, post=post).answer(frame)
        assert got.rdd.getNumPartitions() == lanes and sorted(r.reply for r in got.collect()) == sorted(f"P{i} 1" for i in range(96))
        assert endpoint["most"] <= lanes
    assert endpoint["all"] == 192


def test_retry_after(spark, endpoint):
    url = endpoint["url"]
    post = lambda _, body, headers, timeout: adapters._post(url, body, headers, timeout)
    began = time.monotonic()
    assert adapters.Http("m", pause=0.0, post=post).ask("busy") == "BUSY 1" and time.monotonic() - began >= 1
    pauses, replies = [], iter([adapters.ReplyError(429, "", 7.0), adapters.ReplyError(503, "", 1e9), adapters.ReplyError(503, "", 1.0), adapters.ReplyError(500, "")])

    def call():
        error = next(replies, None)
        if error:
            raise error
        return "done"

    assert adapters.with_retries(call, sleep=pauses.append, pause=5.0) == "done" and pauses == [7.0, 300.0, 5.0, 5.0]
    assert [adapters.retry_after(x, now=0.0) for x in ("12", " 1.5 ", None, "", "soon", "Thu, 01 Jan 1970 00:01:00 GMT", "Wed, 31 Dec 1969 00:00:00 GMT")] == [12.0, 1.5, None, None, None, 60.0, 0.0]


class BreaksOff:
    """Answers so many slices, then fails."""

    def __init__(self, inner, slices):
        self.inner, self.left = inner, slices

    def answer(self, *args):
        if not self.left:
            raise ConnectionError("gone")
        self.left -= 1
        return self.inner.answer(*args)


def test_a_run_goes_on_where_it_broke_off(spark, tmp_path):
    log, path = tmp_path / "log", str(tmp_path / "verdicts")
    model = adapters.Batched(logging_make(str(log)), 4)
    frame = spark.range(60).select("id", F.format_string("p%d", F.col("id") % 50).alias("prompt"), (F.col("id") % 2).alias("reply2")).union(spark.sql("SELECT 0L, 'p0', 1L"))
    with pytest.raises(ConnectionError):
        Resumable(BreaksOff(model, 2), path, "j", at_once=15).answer(frame)
    first = sum(map(len, log_of(log)[1]))
    assert 0 < first < 60
    got = Resumable(model, path, "j", at_once=15).answer(frame).collect()
    assert sorted((r.id, r.reply) for r in got) == sorted([(i, f"P{i % 50}") for i in range(60)] + [(0, "P0")])
    asked = Counter(p for b in log_of(log)[1] for p in b)
    assert sum(asked.values()) == 60  # each sample's request once, over both runs
    again = Resumable(model, path, "j").answer(frame)
    assert again.count() == 61 and sum(map(len, log_of(log)[1])) == 60 and again.columns == ["id", "prompt", "reply2", "reply"]
    stored = spark.read.parquet(path)
    assert stored.count() == 60 == stored.select("judge", "sample", "request").distinct().count()
    # another judge, and another prompt, are other requests
    Resumable(model, path, "k").answer(frame.filter("id < 3")).count()
    assert sum(map(len, log_of(log)[1])) == 63


def test_errors_are_asked_again(spark, tmp_path):
    path = str(tmp_path / "verdicts")
    frame = spark.createDataFrame([(1, ["a", "bad"]), (2, ["c"]), (3, None)], "id long, prompt array<string>")
    model = adapters.Batched(logging_make(str(tmp_path / "log")), 1)
    got = {r.id: r.reply for r in Resumable(model, path, "j").answer(frame).collect()}
    assert got[1] == ["A", "[Error: no]"] and got[2] == ["C"] and got[3] == []
    right = adapters.Rule(lambda rows: F.transform("prompt", F.upper))
    got = {r.id: r.reply for r in Resumable(right, path, "j").answer(frame).collect()}
    assert got[1] == ["A", "BAD"] and got[2] == ["C"]
    adapters.register_model("kept", lambda c: adapters.Rule(lambda rows: F.upper("prompt")))
    assert isinstance(adapters.model_for("kept", {"verdicts": path}), Resumable) and isinstance(adapters.model_for("kept", {}), adapters.Rule)
    del adapters.MODELS["kept"]


def test_frames_and_a_second_try(spark):
    """The first reply of each request can't be read; the second tells how many pictures there were."""
    seen = set()

    def post(url, body, headers, timeout):
        parts = body["messages"][0]["content"]
        if parts[0]["text"] not in seen:
            seen.add(parts[0]["text"])
            return {"choices": [{"message": {"content": "I think that A is better."}}]}
        return {"choices": [{"message": {"content": "```json\n" + json.dumps({"winner": "B", "reason": f"{len(parts) - 1}"}) + "\n```"}}]}

    side = lambda text: spark.createDataFrame([(i, 0, "s", f"{text} {i}") for i in "xyz"], "id string, pos long, source string, text string")
    frames = spark.createDataFrame([("x", ["http://1", "http://2"]), ("y", [])], "id string, frames array<string>")
    got = {r.id: r for r in judged.ranked(side("a"), side("b"), adapters.Http("m", post=post), frames=frames).collect()}
    assert {i: (r.winner, r.reason, r.success) for i, r in got.items()} == {"x": ("B", "2", True), "y": ("B", "0", True), "z": ("B", "0", True)}
    assert [readable_verdict(x) for x in ('{"winner": "tie"}', '```json\n{"winner": "A"}\n```', '{"winner": "C"}', "A", "[1]", "", None)] == [True, True, False, False, False, False, False]
