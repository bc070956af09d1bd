import json

import pytest
from pyspark.sql import functions as F

from scorelake.sources import files, loaders
from scorelake.sources.loaders import DatasetSpec, load, missing_files


def put(path, data=None):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(data) if data is not None else "x")
    return str(path)


def rows(frame):
    return sorted((r.asDict(True) for r in frame.collect()), key=str)


def test_capability(spark, tmp_path):
    put(tmp_path / "images/a.jpg")
    put(tmp_path / "annotations.json", [{"image": "a.jpg", "caption": "c"}, {"image": "gone.jpg", "answer": "x", "id": "7"}])
    spec = DatasetSpec("capability", str(tmp_path))
    (a,) = rows(load(spark, spec))
    assert (a["id"], a["ground_truth"], a["dataset"]) == ("a.jpg", "c", "capability") and a["prompt"] == [loaders.DESCRIBE_IMAGE]
    assert [r.id for r in missing_files(spark, spec).collect()] == ["7"]
    assert load(spark, spec, check_files=False).count() == 2


@pytest.mark.parametrize("wrap", [None, "annotations", "data"])
def test_dream(spark, tmp_path, wrap):
    put(tmp_path / "v/1.mp4")
    put(tmp_path / "v/2.mp4")
    items = [{"idx": 3, "video_file": "v/1.mp4", "description": "d", "events": ["e"], "n_subjects": 2, "n_shots": 1, "duration": 5.09, "source": "s"}, {"video_file": "v/2.mp4", "duration": "00:06"}]
    path = put(tmp_path / "a.json", {wrap: items} if wrap else items)
    a, b = sorted(load(spark, DatasetSpec("dream-1k", str(tmp_path), path)).collect(), key=lambda r: r.id)
    assert (a.id, a.duration_s, a.reference_text) == ("-1", 6.0, [None]) and (b.id, b.duration_s, b.events, b.n_subjects) == ("3", 5.09, ["e"], 2)
    assert load(spark, DatasetSpec("dream-1k", str(tmp_path), path, max_samples=1)).count() == 1


def test_tasks(spark, tmp_path):
    for task in ("temporal", "fact_detect"):
        put(tmp_path / f"notes/{task}/{task}.json", [{"basic": {"video": "1.mp4", "question": "q", "answer": "yes"}, "hallucination": {"question": "h", "answer": "no"}, "type": "t"}])
        put(tmp_path / f"data/{task}/videos/1.mp4")
    got = rows(load(spark, DatasetSpec("video-hallucer", str(tmp_path / "data"), str(tmp_path / "notes"), extra={"tasks": ["temporal", "fact_detect"]})))
    assert [(g["task"], g["prompt"], g["reference_text"]) for g in got] == [("fact_detect", ["q", "h"], ["yes", "no"]), ("temporal", ["q", "h"], ["yes", "no"])]
    for task in loaders.EVENT_TASKS:
        put(tmp_path / f"ev/{task}_questions.json", [{"id": f"{task}_001", "questions": [{"question": "q?", "answer": "Yes."}], "event_info": {"unexpected": "u", "caption": "c"}, "length": 3, "category": "k"}])
        put(tmp_path / f"ev/{task}/{task}_001.mp4")
    got = {r.task: r for r in load(spark, DatasetSpec("event-hallusion", str(tmp_path / "ev"), str(tmp_path / "ev"))).collect()}
    assert got["interleave"].reference_text == ["Yes.", "u"] and got["entire"].reference_text == ["Yes.", "c"] and got["entire"].id == "001" and len(got["entire"].prompt) == 2


def test_maps(spark, tmp_path):
    put(tmp_path / "vid.mp4")
    path = put(tmp_path / "p.json", {"vid": {"mc_question": [{"question": "q", "options": ["a", "b", "c"], "answer_id": 2}]}, "none": {"mc_question": []}})
    (got,) = load(spark, DatasetSpec("perception-test", str(tmp_path), path)).collect()
    assert got.reference_text == ["2"] and "1) b" in got.prompt[0]
    put(tmp_path / "human/k.mp4")
    put(tmp_path / "t/count.json", {"0": {"key": "k", "demonstration_type": "human", "question": "q", "options": ["1", "2"], "answer": 1}})
    (got,) = load(spark, DatasetSpec("tomato", str(tmp_path), str(tmp_path / "t"), extra={"tasks": ["count"]})).collect()
    assert (got.id, got.options, got.reference_idx, got.source, got.task) == ("0", ["1", "2"], 1, "human", "count")
    put(tmp_path / "action_localization/1.mp4")
    put(tmp_path / "t/action_localization.json", [{"video": "gone.mp4"}, {"video": "1.mp4", "question": "q", "candidates": ["x", "y"], "answer": "y", "video_length": 9.5}])
    (got,) = load(spark, DatasetSpec("tvbench", str(tmp_path), str(tmp_path / "t"))).collect()
    assert (got.id, got.reference_text, got.duration_s) == ("1", ["y"], 9.5)


def test_categories(spark, tmp_path):
    for name in ("shorts/1.mp4", "shorts/10.mp4", "stock/2.mp4", "elsewhere/3.mp4"):
        put(tmp_path / name)
    got = load(spark, DatasetSpec("test50-camera", str(tmp_path)))
    assert sorted(r.id for r in got.collect()) == ["shorts_1", "shorts_10", "stock_2"]
    path = put(tmp_path / "n.json", [{"video_id": "1", "category": "shorts", "description": "d", "caption": ""}, {"id": "2", "category": "stock"}, {"id": "9"}])
    got = rows(load(spark, DatasetSpec("test50-dense", str(tmp_path), path)))
    assert [(g["id"], g["reference_text"], g["source"]) for g in got] == [("1", ["d"], "shorts"), ("2", None, "stock")]


def test_generic(spark, tmp_path):
    put(tmp_path / "images/a.jpg")
    absolute = put(tmp_path / "b.jpg")
    items = [{"filename": "a.jpg", "question": "q", "label": "l", "sample_id": 4, "mood": "m"}, {"image": "", "image_name": absolute}, {"prompt": "no image"}]
    for data in (items, {"samples": items}):
        put(tmp_path / "annotations.json", data)
        a, b = rows(load(spark, DatasetSpec("other", str(tmp_path))))
        one, two = (a, b) if a["id"] == "4" else (b, a)
        assert one["extra"] == {"extra_mood": "m"} and one["ground_truth"] == "l" and one["prompt"] == ["q"] and two["id"] == absolute
    put(tmp_path / "annotations.json", items[0])
    assert load(spark, DatasetSpec("other", str(tmp_path))).count() == 1


def test_predictions(spark, tmp_path):
    items = [{"id": 1, "prediction": "text", "reference": "r"}, {"idx": 2, "prediction": ["a", "b"], "reference": 1, "o": [[1, 2], "x"], "p": 0, "a": "(A)", "tgt": [[1, 2.5]]}, {"idx": 3, "tgt": [3, 4]}, {"idx": 4, "tgt": [[[1, 2]], [[3, 4]]]}]
    a, b, c, d = load(spark, DatasetSpec("x", load_predictions_from_file=put(tmp_path / "p.json", items))).orderBy("id").collect()
    assert a.prediction == ["text"] and a.reference_text == ["r"] and b.prediction == ["a", "b"] and b.reference_idx == 0 and b.answer_text == "(A)"
    assert [[tuple(s) for s in y] for y in b.gt_segments] == [[(1, 2.5)]] and [[tuple(s) for s in y] for y in c.gt_segments] == [[(3, 4)]] and [[tuple(s) for s in y] for y in d.gt_segments] == [[(1, 2)], [(3, 4)]]


def test_et_captioning(spark, tmp_path):
    put(tmp_path / "videos/v.mp4")
    path = put(tmp_path / "e.json", [{"idx": 1, "video": "v.mp4", "q": "q", "tgt": [[0, 2]], "g": ["c"], "duration": 4, "task": "dvc", "source": "s"}])
    (got,) = load(spark, DatasetSpec("etbench-captioning", str(tmp_path), path)).collect()
    assert got.events == ["c"] and got.gt_segments[0][0].end == 2 and got.task == "dvc"


def test_structure(spark, tmp_path):
    assert {r.kind for r in files.structure(spark, str(tmp_path)).collect()} == {"issue", "suggestion"}
    put(tmp_path / "data.json", [])
    put(tmp_path / "images/a.jpg")
    put(tmp_path / "images/b.PNG")
    assert sorted(tuple(r) for r in files.structure(spark, str(tmp_path)).collect()) == [("annotation", "data.json", 1), ("images", "images", 2)]
    assert files.listing(spark, str(tmp_path / "nowhere")).count() == 0


def test_own_type(spark):
    loaders.register("mine", lambda s, spec: s.range(3).select(F.col("id").cast("string")))
    assert load(spark, DatasetSpec("mine"), check_files=False).count() == 3
