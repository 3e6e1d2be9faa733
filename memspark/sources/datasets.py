"""Readers of dialogue benchmarks, their validation, and result files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memspark.functions.temporal import session_date

TURN = "array<struct<speaker: string, text: string, dia_id: string, blip_caption: string>>"
QA = "array<struct<question: string, answer: variant, category: int, evidence: array<string>>>"


def read_dialogues(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Turns (sample_id, session, date, place, speaker, text, dia_id) and questions (sample_id, question, answer, category, evidence).

    Sessions are keys session_1, session_2, ... beside session_1_date_time, so a conversation is read as a map of values.
    """
    raw = spark.read.text(path, wholetext=True)
    rows = raw.select(F.explode(F.from_json("value", "array<struct<sample_id: string, conversation: string, qa: string>>")).alias("s")).select("s.*")
    keys = rows.select("sample_id", F.explode(F.from_json("conversation", "map<string, string>")).alias("key", "value"))
    number = F.regexp_extract("key", r"^session_(\d+)", 1)
    keys = keys.where("key rlike '^session_[0-9]+'").withColumn("session", number.cast("int"))
    dates = keys.where("key like '%date_time'").select("sample_id", "session", session_date(F.col("value")).alias("date"))
    turns = keys.where("key rlike '^session_[0-9]+$'").select("sample_id", "session", F.posexplode(F.from_json("value", TURN)).alias("place", "t"))
    said = F.concat(F.coalesce("t.text", F.lit("")), F.coalesce(F.concat(F.lit(" [image: "), F.col("t.blip_caption"), F.lit("]")), F.lit("")))
    turns = turns.join(dates, ["sample_id", "session"], "left").select("sample_id", "session", "date", "place", "t.speaker", said.alias("text"), "t.dia_id")
    qa = rows.select("sample_id", F.explode(F.from_json("qa", QA)).alias("q")).select("sample_id", "q.question", F.col("q.answer").cast("string").alias("answer"), "q.category", "q.evidence")
    return turns, qa


LONG = "question_id string, question_type string, question string, answer string, question_date string, haystack_dates array<string>, haystack_session_ids array<string>, haystack_sessions array<array<struct<role: string, content: string>>>, answer_session_ids array<string>"


def read_long_memory(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LONG).json(path, multiLine=True)


def errors_of(questions: DataFrame) -> DataFrame:
    """question_id and errors, all that is wrong with it, of the questions with any."""
    sessions = F.size("haystack_sessions")
    checks = [
        (F.size("haystack_dates") != sessions, "as many dates as sessions are needed"),
        (F.size("haystack_session_ids") != sessions, "as many session ids as sessions are needed"),
        (F.col("answer").isNull(), "an answer is needed"),
        (F.try_to_timestamp(F.regexp_replace("question_date", r" \([A-Za-z]{3}\)", ""), F.lit("yyyy/MM/dd HH:mm")).isNull(), "the question's date can't be read"),
        (F.size(F.array_except("answer_session_ids", "haystack_session_ids")) > 0, "an answer's session isn't among the sessions"),
    ]
    found = F.filter(F.array(*[F.when(F.coalesce(test, F.lit(True)), F.lit(message)) for test, message in checks]), lambda x: x.isNotNull())
    return questions.select("question_id", found.alias("errors")).where(F.size("errors") > 0)


def session_turns(questions: DataFrame) -> DataFrame:
    """conv_id, session, turn, role, text of the haystacks, for round segmentation and rendering."""
    each = questions.select("question_id", F.posexplode(F.arrays_zip("haystack_sessions", "haystack_dates")).alias("session", "s"))
    turns = each.select("question_id", "session", F.col("s.haystack_dates").alias("date"), F.posexplode("s.haystack_sessions").alias("turn", "t"))
    return turns.select(F.concat_ws("#", "question_id", "session").alias("conv_id"), "session", "date", "turn", F.col("t.role").alias("role"), F.col("t.content").alias("text"))


def write_results(results: DataFrame, path: str) -> None:
    """Results as gzipped JSON lines."""
    results.write.option("compression", "gzip").json(path)


def read_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


#: Files of a run, beside each other in its folder.
RESULTS, SUMMARY, DEBUG = "results", "summary", "debug"


def write_run(results: DataFrame, usage: DataFrame, path: str, total_time_s: float, debug: DataFrame | None = None) -> None:
    """A run's folder: results (question_id, category, conversation, correct, f1 and others) in the order of reports, a summary of one JSON
    object, and, where given, debug records (question_id and others) beside them.

    The summary has the time, the overall counts and means, those of each category and conversation, and usage (stage and sums) by stage.
    """
    from memspark.operators import evaluate

    ranked = evaluate.ordered(results)
    write_results(ranked.repartitionByRange("place").sortWithinPartitions("place").drop("place"), f"{path}/{RESULTS}")
    if debug is not None:
        write_results(debug, f"{path}/{DEBUG}")
    level = F.when(F.col("category").isNotNull(), "per_category").when(F.col("conversation").isNotNull(), "per_conversation").otherwise("overall")
    means = [c for c in evaluate.report(results).columns if c not in ("category", "conversation")]
    report = evaluate.report(results.fillna("", ["category", "conversation"])).select(level.alias("level"), F.coalesce("category", "conversation", F.lit("")).alias("name"), F.struct(*means).alias("row"))
    # a summary is one small object: a row for each category, conversation and stage
    lists = report.groupBy().pivot("level", ["overall", "per_category", "per_conversation"]).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "row")))))
    stages = usage.groupBy().agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("stage", F.struct(*[c for c in usage.columns if c != "stage"]).alias("row"))))).alias("stage_usage"))
    summary = lists.crossJoin(stages).select(F.lit(float(total_time_s)).alias("total_time_s"), F.element_at("overall", "").alias("overall"), "per_category", "per_conversation", "stage_usage")
    summary.coalesce(1).write.json(f"{path}/{SUMMARY}")


def read_summary(spark: SparkSession, path: str) -> dict:
    """A run's summary."""
    import json

    return json.loads(spark.read.text(f"{path}/{SUMMARY}").first().value)
