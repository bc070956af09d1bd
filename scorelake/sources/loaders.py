"""Benchmark annotations as tables of samples.

Each loader reads JSON with a declared schema, names columns by the canonical schema, and keeps samples whose media file is in the
listing of the data folder: a semi-join with file names, not a look at the disk for every row. `missing_files` gives the others.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.functions.temporal import clock_seconds
from scorelake.functions.text import first_truthy, stem_of_path
from scorelake.schema import canonical
from scorelake.sources import files, json_splits

# The benchmarks' task names.
HALLUCER_TASKS = ["object_relation", "temporal", "semantic_detail", "interaction", "external_factual", "external_nonfactual", "fact_detect"]
EVENT_TASKS = ["entire", "interleave", "misleading"]
TV_TASKS = ["action_localization"]
TOMATO_TASKS = ["count", "direction", "rotation", "shape&trend", "velocity&frequency", "visual_cues"]
CATEGORIES = ["movie_animation", "movie_live_action", "shorts", "stock", "youtube"]
# Names under which generic annotations hold a list, an image, a prompt, a reference and an id.
LIST_KEYS = ["annotations", "data", "samples", "images"]
IMAGE_KEYS = ["image", "image_name", "image_path", "filename", "file_name"]
PROMPT_KEYS = ["prompt", "question", "text", "instruction"]
TRUTH_KEYS = ["ground_truth", "caption", "answer", "label", "description"]
ID_KEYS = ["id", "image_id", "sample_id"]
# Our own wording of the prompts.
DESCRIBE_IMAGE = "Describe what this image shows."
DESCRIBE_VIDEO = "Describe this video as fully as you can."
CAMERA_PROMPT = "Describe the camera's movement in this video."
YES_NO_SUFFIX = "\nAnswer with yes or no:"
DIGIT_PROMPT = "Watch the video, then answer.\n%s\n0) %s\n1) %s\n2) %s\nReply with the number of your choice only."
OPTION_PROMPT = "Watch the video, then answer.\n%s\nCandidates:\n%s\nReply with one candidate, word for word."


@dataclass
class DatasetSpec:
    """Where a dataset is: its type, data folder, annotation file or folder, and most samples (0: all)."""

    type: str
    data_path: str = ""
    annotation_file: str = ""
    image_dir: str = "images"
    max_samples: int = 0
    load_predictions_from_file: str = ""
    name: str = ""
    extra: dict = field(default_factory=dict)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file with a JSON list, read by many tasks, or with one object: a row for each element. An element that isn't of the schema is a row of nulls."""
    found = json_splits.split(spark, path, lists_under_keys=False)
    rows = found.elements([(f, None) for f, top in found.tops.items() if top == "["]).select(F.from_json("text", schema).alias("item")).select("item.*")
    single = [unquote(f) for f, top in found.tops.items() if top != "["]
    return rows.union(spark.read.option("multiLine", "true").schema(schema).json(single)) if single else rows


def read_map(spark: SparkSession, path: str, value: str) -> DataFrame:
    """(key, value) of a file with one JSON object, read by many tasks."""
    found = json_splits.split(spark, path, lists_under_keys=False)
    members = found.elements([(f, None) for f, top in found.tops.items() if top == "{"])
    return members.select(F.explode(F.from_json(F.concat(F.lit("{"), "text", F.lit("}")), f"map<string,{value}>")).alias("key", "value"))


def _listed(spark: SparkSession, path: str, keys: list[str]) -> tuple[json_splits.Split, DataFrame]:
    """(file, key, pos, text) of each file's list, or of the list under the first of the keys that has one."""
    found = json_splits.split(spark, path, lists_under_keys=True)
    wanted: list[tuple[str, str | None]] = []
    for file, top in found.tops.items():
        under = [k for k in keys if (k, "[") in found.containers.get(file, [])]
        wanted += [(file, None)] if top == "[" else [(file, under[0])] if under else []
    return found, found.elements(wanted)


def read_wrapped(spark: SparkSession, path: str, item: str) -> DataFrame:
    """Rows of a list, or of the list under annotations, else data, of an object, read by many tasks; pos is an element's place in its list."""
    if not item.removeprefix("struct<").removesuffix(">"):
        raise ValueError("a schema without fields")
    _, rows = _listed(spark, path, ["annotations", "data"])
    return rows.select(F.col("pos").cast("int").alias("pos"), F.from_json("text", item).alias("item")).select("pos", "item.*")


def _join(*parts: Column | str) -> Column:
    return F.concat_ws("/", *[F.lit(p.rstrip("/")) if isinstance(p, str) else p for p in parts])


def _segments(column: str) -> Column:
    """Two or three levels of lists as intervals by annotator."""
    pair = lambda s: F.struct(s[0].alias("start"), s[1].alias("end"))
    return F.array(F.transform(column, pair))


def _times(rows: DataFrame) -> DataFrame:
    return rows.withColumn("duration_s", clock_seconds(F.col("duration_raw")))


def _capability(spark: SparkSession, spec: DatasetSpec) -> DataFrame:
    rows = read_json(spark, spec.annotation_file or f"{spec.data_path}/annotations.json", "image string, id string, prompt string, caption string, answer string")
    return rows.select(F.coalesce("id", "image").alias("id"), _join(spec.data_path, spec.image_dir, F.col("image")).alias("image_path"), F.array(F.coalesce("prompt", F.lit(DESCRIBE_IMAGE))).alias("prompt"), F.coalesce("caption", "answer").alias("ground_truth"))


def _dream(spark: SparkSession, spec: DatasetSpec) -> DataFrame:
    rows = read_wrapped(spark, spec.annotation_file, "struct<idx:string,video_file:string,description:string,events:array<string>,n_subjects:int,n_shots:int,duration:string,source:string>")
    return _times(rows.select(F.coalesce("idx", F.lit("-1")).alias("id"), _join(spec.data_path, F.col("video_file")).alias("video_path"), F.array("description").alias("reference_text"), "events", "n_subjects", "n_shots", F.col("duration").alias("duration_raw"), "source", "pos"))


def _et_captioning(spark: SparkSession, spec: DatasetSpec) -> DataFrame:
    rows = read_json(spark, spec.annotation_file, "idx string, video string, q string, tgt array<array<double>>, g array<string>, duration string, source string, task string, o array<string>, p int, a string")
    made = rows.select(
        F.coalesce("idx", F.lit("-1")).alias("id"), _join(spec.data_path, "videos", F.col("video")).alias("video_path"), F.array("q").alias("prompt"), _segments("tgt").alias("gt_segments"), F.col("g").alias("events"), F.col("duration").alias("duration_raw"), "source", "task",
        F.col("o").alias("options"), F.col("p").alias("reference_idx"), F.col("a").alias("answer_text"),
    )
    return _times(made)


def _hallucer(spark: SparkSession, spec: DatasetSpec) -> DataFrame:
    def one(task: str) -> DataFrame:
        rows = read_json(spark, f"{spec.annotation_file}/{task}/{task}.json", "basic struct<video:string,question:string,answer:string>, hallucination struct<question:string,answer:string>, type string")
        both = lambda c: F.array(f"basic.{c}", f"hallucination.{c}")
        return rows.select(_join(spec.data_path, task, "videos", F.col("basic.video")).alias("video_path"), both("question").alias("prompt"), both("answer").alias("reference_text"), F.col("type").alias("source"), F.lit(task).alias("task"))

    return _union([one(t) for t in spec.extra.get("tasks", HALLUCER_TASKS)])


def _event_hallusion(spark: SparkSession, spec: DatasetSpec) -> DataFrame:
    def one(task: str) -> DataFrame:
        rows = read_json(spark, f"{spec.annotation_file}/{task}_questions.json", "id string, questions array<struct<question:string,answer:string>>, event_info struct<unexpected:string,caption:string>, length string, category string")
        told = F.col("event_info.unexpected") if task == "interleave" else F.col("event_info.caption")
        return rows.select(
            F.get(F.split("id", "_"), 1).alias("id"), _join(spec.data_path, task, F.concat("id", F.lit(".mp4"))).alias("video_path"), F.concat(F.transform("questions", lambda q: F.concat(q["question"], F.lit(YES_NO_SUFFIX))), F.array(F.lit(DESCRIBE_VIDEO))).alias("prompt"),
            F.concat(F.transform("questions", lambda q: q["answer"]), F.array(told)).alias("reference_text"), F.col("length").alias("duration_raw"), F.col("category").alias("source"), F.lit(task).alias("task"),
        )

    return _times(_union([one(t) for t in spec.extra.get("tasks", EVENT_TASKS)]))


def _perception(spark: SparkSession, spec: DatasetSpec) -> DataFrame:
    rows = read_map(spark, spec.annotation_file, "struct<mc_question:array<struct<question:string,options:array<string>,answer_id:int>>>")
    ask = lambda q: F.format_string(DIGIT_PROMPT, q["question"], F.get(q["options"], 0), F.get(q["options"], 1), F.get(q["options"], 2))
    q = F.col("value.mc_question")
    return rows.select(F.col("key").alias("id"), _join(spec.data_path, F.concat("key", F.lit(".mp4"))).alias("video_path"), F.transform(q, ask).alias("prompt"), F.transform(q, lambda x: x["answer_id"].cast("string")).alias("reference_text"))


def _categories(prompt: str) -> Callable[[SparkSession, DatasetSpec], DataFrame]:
    def load(spark: SparkSession, spec: DatasetSpec) -> DataFrame:
        if spec.annotation_file:
            rows = read_json(spark, spec.annotation_file, "video_id string, id string, category string, prompt string, caption string, description string, answer string")
            name, category = first_truthy(F.col("video_id"), F.col("id")), F.coalesce("category", F.lit("unknown"))
            told = first_truthy(F.col("caption"), F.col("description"), F.col("answer"))
            return rows.select(name.alias("id"), _join(spec.data_path, category, F.concat(name, F.lit(".mp4"))).alias("video_path"), F.array(F.coalesce("prompt", F.lit(prompt))).alias("prompt"), F.when(told.isNotNull(), F.array(told)).alias("reference_text"), category.alias("source"))
        found = files.listing(spark, spec.data_path, "*.mp4")
        category = F.element_at(F.split("path", "/"), -2)
        rows = found.filter(category.isin(spec.extra.get("categories", CATEGORIES)))
        return rows.select(F.concat_ws("_", category, stem_of_path(F.col("path"))).alias("id"), F.col("path").alias("video_path"), F.array(F.lit(prompt)).alias("prompt"), category.alias("source"), F.lit("video_captioning").alias("task"))

    return load


def _tv(spark: SparkSession, spec: DatasetSpec) -> DataFrame:
    def one(task: str) -> DataFrame:
        rows = read_wrapped(spark, f"{spec.annotation_file}/{task}.json", "struct<video:string,question:string,candidates:array<string>,answer:string,video_length:string>")
        asked = F.format_string(OPTION_PROMPT, F.col("question"), F.to_json("candidates"))
        return rows.select(F.col("pos").cast("string").alias("id"), _join(spec.data_path, task, F.col("video")).alias("video_path"), F.array(asked).alias("prompt"), F.array("answer").alias("reference_text"), F.col("candidates").alias("options"), F.col("video_length").alias("duration_raw"), F.lit(task).alias("task"), "pos")

    return _times(_union([one(t) for t in spec.extra.get("tasks", TV_TASKS)]))


def _tomato(spark: SparkSession, spec: DatasetSpec) -> DataFrame:
    def one(task: str) -> DataFrame:
        rows = read_map(spark, f"{spec.annotation_file}/{task}.json", "struct<key:string,demonstration_type:string,question:string,options:array<string>,answer:int>")
        v = F.col("value")
        asked = F.format_string(OPTION_PROMPT, v["question"], F.to_json(v["options"]))
        return rows.select(F.col("key").alias("id"), _join(spec.data_path, v["demonstration_type"], F.concat(v["key"], F.lit(".mp4"))).alias("video_path"), F.array(asked).alias("prompt"), v["answer"].alias("reference_idx"), v["options"].alias("options"), v["demonstration_type"].alias("source"), F.lit(task).alias("task"))

    return _union([one(t) for t in spec.extra.get("tasks", TOMATO_TASKS)])


def _generic(spark: SparkSession, spec: DatasetSpec) -> DataFrame:
    """Annotations of any keys: each object is read as a map from keys to text."""
    path = f"{spec.data_path}/{spec.annotation_file or 'annotations.json'}" if not spec.annotation_file.startswith("/") else spec.annotation_file
    found, listed = _listed(spark, path, LIST_KEYS)
    rows = listed.select(F.col("pos").cast("int").alias("pos"), F.from_json("text", "map<string,string>").alias("m"))
    alone = [unquote(f) for f, top in found.tops.items() if top == "{" and not {k for k, _ in found.containers.get(f, [])} & set(LIST_KEYS)]
    if alone:  # an object of no such list is the one sample
        rows = rows.union(spark.read.text(alone, wholetext=True).select(F.lit(0), F.from_json("value", "map<string,string>")))
    get = lambda keys: first_truthy(*[F.col("m")[k] for k in keys])
    image = get(IMAGE_KEYS)
    known = [*IMAGE_KEYS, *PROMPT_KEYS, *TRUTH_KEYS, *ID_KEYS]
    rest = F.transform_keys(F.map_filter("m", lambda k, v: ~k.isin(known)), lambda k, v: F.concat(F.lit("extra_"), k))
    return rows.filter(image.isNotNull()).select(
        F.coalesce(get(ID_KEYS), image).alias("id"), F.when(image.startswith("/"), image).otherwise(_join(spec.data_path, spec.image_dir, image)).alias("image_path"), F.array(F.coalesce(get(PROMPT_KEYS), F.lit(DESCRIBE_IMAGE))).alias("prompt"), get(TRUTH_KEYS).alias("ground_truth"), rest.alias("extra"), "pos",
    )


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


LOADERS: dict[str, Callable[[SparkSession, DatasetSpec], DataFrame]] = {
    "capability": _capability, "dream-1k": _dream, "etbench-captioning": _et_captioning, "video-hallucer": _hallucer, "event-hallusion": _event_hallusion, "perception-test": _perception,
    "test50-camera": _categories(CAMERA_PROMPT), "test50-dense": _categories(DESCRIBE_VIDEO), "tvbench": _tv, "tomato": _tomato, "generic": _generic,
}


def register(name: str, loader: Callable[[SparkSession, DatasetSpec], DataFrame]) -> None:
    """Adds a dataset type, or replaces one."""
    LOADERS[name] = loader


def loader_for(spec: DatasetSpec) -> Callable[[SparkSession, DatasetSpec], DataFrame]:
    """By type, else by name, else the generic one."""
    return LOADERS.get(spec.type) or LOADERS.get(spec.name) or LOADERS["generic"]


def annotated(spark: SparkSession, spec: DatasetSpec) -> DataFrame:
    """All annotated samples, whether or not their files are there."""
    return canonical(loader_for(spec)(spark, spec)).withColumn("dataset", F.lit(spec.name or spec.type))


def _media(rows: DataFrame) -> DataFrame:
    return rows.withColumn("media", F.coalesce("video_path", "image_path"))


def load(spark: SparkSession, spec: DatasetSpec, check_files: bool = True) -> DataFrame:
    """Samples of a dataset whose files are there, or stored predictions; at most max_samples, in the order of position and id."""
    if spec.load_predictions_from_file:
        rows = canonical(predictions(spark, spec.load_predictions_from_file)).withColumn("dataset", F.lit(spec.name or spec.type))
    else:
        rows = annotated(spark, spec)
        if check_files:
            rows = files.present(_media(rows), files.listing(spark, spec.data_path), "media").drop("media")
    return rows.orderBy("pos", "id").limit(spec.max_samples) if spec.max_samples else rows


def missing_files(spark: SparkSession, spec: DatasetSpec) -> DataFrame:
    """(id, media): annotated samples without their file."""
    return files.missing(_media(annotated(spark, spec)), files.listing(spark, spec.data_path), "media").select("id", "media")


def in_subset(rows: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    """Rows whose (task, source, id) a JSON file of {task: {source: [id, ...]}} lists."""
    listed = read_map(spark, path, "map<string,array<string>>").select(F.col("key").alias("task"), F.explode("value").alias("source", "ids")).select("task", "source", F.explode("ids").alias("id"))
    return rows.join(listed, ["task", "source", "id"], "left_semi")


STORED = """struct<id:string,video_path:string,image_path:string,prompt:string,prediction:string,reference:string,ground_truth:string,events:string,options:string,task:string,source:string,duration:string,
  idx:string,o:string,p:int,a:string,tgt:string,n_subjects:int,n_shots:int>""".replace("\n", "").replace("  ", "")


def _texts(column: str) -> Column:
    """A JSON list of texts, or one text, as an array."""
    return F.when(F.col(column).isNull(), None).when(F.substring(column, 1, 1) == "[", F.coalesce(F.from_json(column, "array<string>"), F.array(column))).otherwise(F.array(column))


def _intervals(column: str) -> Column:
    """Lists of intervals of one, two or three levels, by annotator."""
    pair = lambda s: F.struct(F.get(s, 0).alias("start"), F.get(s, 1).alias("end"))
    one, two, three = (F.from_json(column, t) for t in ("array<double>", "array<array<double>>", "array<array<array<double>>>"))
    depth = F.length(F.regexp_extract(F.regexp_replace(column, r"\s", ""), r"^(\[+)", 1))
    return F.when(depth == 3, F.transform(three, lambda a: F.transform(a, pair))).when(depth == 2, F.array(F.transform(two, pair))).when(depth == 1, F.array(F.array(pair(one))))


def _fields() -> list[list[str]]:
    return [f.split(":") for f in STORED.removeprefix("struct<").removesuffix(">").replace(" ", "").split(",")]


def _stored(rows: DataFrame) -> DataFrame:
    """Rows of a Parquet table with STORED's columns: lists are written as JSON, as in the other forms, and missing columns are null."""
    have = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    text = lambda c: F.to_json(c) if have[c].startswith(("array", "struct", "map")) else F.col(c)
    return rows.select(*[(text(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in _fields()], (F.col("pos").cast("long") if "pos" in have else F.monotonically_increasing_id()).alias("pos"))


def predictions(spark: SparkSession, path: str) -> DataFrame:
    """Stored predictions: a JSON list, or one under annotations or data, JSON lines (.jsonl) or Parquet; all are split among tasks.
    prompt, prediction and reference may each be a text or a list. Lines have no order but their file's; pos then grows with it."""
    if path.rstrip("/").endswith((".jsonl", ".ndjson")):
        rows = spark.read.schema(", ".join(map(" ".join, _fields()))).json(path).withColumn("pos", F.monotonically_increasing_id())
    elif path.rstrip("/").endswith(".parquet"):
        rows = _stored(spark.read.parquet(path))
    else:
        rows = read_wrapped(spark, path, STORED)
    made = rows.select(
        F.coalesce("id", "idx").alias("id"), "video_path", "image_path", _texts("prompt").alias("prompt"), _texts("prediction").alias("prediction"), _texts("reference").alias("reference_text"), F.coalesce("p", F.col("reference").try_cast("int")).alias("reference_idx"), "ground_truth",
        _texts("events").alias("events"), F.coalesce(_texts("options"), _texts("o")).alias("options"), F.col("a").alias("answer_text"), _intervals("tgt").alias("gt_segments"), "n_subjects", "n_shots", F.col("duration").alias("duration_raw"), "task", "source", F.col("pos").cast("long").alias("pos"),
    )
    return _times(made)
