"""Every operator as a query over the given tables.

Arrays are returned as rows or as joined text, and doubles rounded to six
digits, so that results of two engines can be compared by value.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from voxframe.functions import arrays as A
from voxframe.functions.audio import clip_duration, context_frames
from voxframe.functions.text import repetition_score as repetition
from voxframe.functions.text import run_label, tokens
from voxframe.operators import combining, inference, metrics, order, pseudo, rows, runs, scores, sequences
from voxframe.operators.grid import ALPHAS, TEMPERATURES, sweep_grid
from voxframe.plans import views as V
from voxframe.plans import training
from voxframe.session import scratch_dir, whole_div
from voxframe.session import stored as kept
from voxframe.sources import logs, snapshots, tables
from voxframe.sources import scores as stored
from voxframe.streaming import jobs

TOP = 10
VOCAB = 2_000
Query = Callable[[SparkSession, str], DataFrame]


def r6(c: Column | str) -> Column:
    # adding zero turns a negative zero into a plain one
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def joined(c: str) -> Column:
    return F.array_join(F.col(c).cast("array<string>"), " ")


# --- sources and sinks


def _stream(spark, sf, name, files_per_trigger=None):
    """A table as a stream; the path is a pattern, which a folder of files matches as well as a single file."""
    schema = V.table(spark, sf, name).schema
    return tables.read_stream_source(spark, f"{sf}/{name}[.]parquet", schema, files_per_trigger)


def scan_split(spark, sf):
    return tables.read_split(spark, f"{sf}/documents.parquet", "fr", "lang").select("doc_id", "lang", "n_chars")


def stream_valid_clips(spark, sf):
    out = scratch_dir(spark, "valid-clips")
    clips = _stream(spark, sf, "documents").select(
        F.col("doc_id").alias("clip_id"),
        F.when(F.col("doc_id") % 17 == 0, "  ").otherwise(F.col("text")).alias("text"),
        "lang",
        F.when(F.col("doc_id") % 13 != 0, F.struct(F.array("n_chars").alias("array"))).alias("audio"),
    )
    prepared = jobs.prepare(clips, ["clip_id", "text", "lang"])
    jobs.run_available(prepared, f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{out}/rows")


def topk_roundtrip(spark, sf):
    out = scratch_dir(spark, "teacher-scores")
    top = scores.top_k_per_position(V.teacher_positions(spark, sf), TOP)
    stored.write_teacher_scores(top, out)
    long = scores.explode_top(stored.read_teacher_scores(spark, out))
    return long.withColumn("logit", r6(F.col("logit").cast("double")))


def optional_split(spark, sf):
    return tables.read_optional_split(spark, f"{sf}/documents.parquet", "de", "lang").select("doc_id", "lang", "n_chars")


def _examples(vectors):
    return vectors.select(
        F.col("vec_id").alias("example_pos"), "label", "embedding",
        F.when(F.col("vec_id") % 17 == 0, " ").otherwise("a").alias("text"), F.struct(F.lit(1).alias("array")).alias("audio"),
    )


def _score(valid: DataFrame) -> DataFrame:
    teacher = F.transform(F.col("embedding").cast("array<double>"), lambda v: v * 10)
    return valid.select("example_pos", F.lit(0).alias("tok_pos"), F.col("label").alias("label_id"), teacher.alias("teacher"))


def _scored_stream(spark, sf):
    """Every vector is an example of one token; the second run has lost its checkpoint and finds everything stored."""
    out = scratch_dir(spark, "scored")
    examples = _examples(_stream(spark, sf, "embeddings"))
    for turn in (1, 2):
        jobs.score_stream(examples, _score, TOP, out, f"{out}/checkpoint-{turn}", {}).awaitTermination()
    return out


def stream_scores(spark, sf):
    back = stored.read_teacher_scores(spark, f"{_scored_stream(spark, sf)}/scores")
    return scores.explode_top(back).withColumn("logit", r6(F.col("logit").cast("double")))


def scores_in_parts(spark, sf):
    """The first run ends in the middle of a part, the second one goes on there."""
    out, vectors = scratch_dir(spark, "scored"), V.table(spark, sf, "embeddings")
    n = vectors.select(F.max("vec_id") + 1).first()[0]
    for stop_at in (n // 2, None):
        jobs.score_table(_examples(vectors), _score, TOP, out, {}, stop_at, max(1, n // 3))
    back = stored.read_teacher_scores(spark, f"{out}/scores")
    return scores.explode_top(back).withColumn("logit", r6(F.col("logit").cast("double")))


def stream_progress(spark, sf):
    out = _scored_stream(spark, sf)
    jobs.mark_complete(spark, out)
    last = logs.read_progress(spark, f"{out}/progress")
    last.pop("batch_id")
    row = spark.createDataFrame([last], logs.PROGRESS_SCHEMA)
    return row.select("top_k", "next_idx", "examples_processed", "complete")


def stream_shuffle(spark, sf):
    out = scratch_dir(spark, "shuffled")
    clips = _stream(spark, sf, "documents").select(F.col("doc_id").alias("clip_id"))
    jobs.shuffle_stream(clips, 42, "clip_id", f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{out}/rows").select("clip_id", "shuffle_pos")


def stream_buffers(spark, sf):
    """Buffers of 100 rows over triggers of one file, the last one drained at the end.

    `shuffle_stream` takes rows in the order of the key, in which the files of a table need not arrive. So the ids
    arrive in ranges, one for each file of the table and eight at most, and every range is a run that goes on from the last.
    """
    out = scratch_dir(spark, "shuffled")
    docs = V.table(spark, sf, "documents")
    clips, n = kept(docs.select(F.col("doc_id").alias("clip_id")).orderBy("clip_id"), "clips"), min(len(docs.inputFiles()), 8)
    ends = clips.agg(F.percentile_approx("clip_id", [i / n for i in range(1, n + 1)])).first()[0] or [None]
    bounds = [None, *ends[:-1], None]
    for low, high in zip(bounds, bounds[1:]):
        due = clips if low is None else clips.where(F.col("clip_id") > low)
        due = due if high is None else due.where(F.coalesce(F.col("clip_id") <= high, F.lit(True)))
        due.coalesce(1).write.mode("append").parquet(f"{out}/arrived")
        arrived = tables.read_stream_source(spark, f"{out}/arrived", clips.schema, 1)
        jobs.shuffle_stream(arrived, 42, "clip_id", out, f"{out}/checkpoint", buffer=100).awaitTermination()
    jobs.drain_shuffle(spark, 42, "clip_id", out, 100)
    return spark.read.parquet(f"{out}/rows").select("clip_id", "shuffle_pos")


def score_source(spark, sf):
    """Without a table the scores are live; written, they are found at the default path."""
    out = scratch_dir(spark, "teacher-scores")
    live = lambda: scores.top_k_per_position(V.teacher_positions(spark, sf), TOP)
    found = [stored.choose_score_source(spark, None, out, live)]
    stored.write_teacher_scores(found[0][1], out)
    found.append(stored.choose_score_source(spark, None, out, live))
    first, second = (scores.explode_top(df).withColumn("source", F.lit(name)) for name, df in found)
    return first.unionByName(second).withColumn("logit", r6(F.col("logit").cast("double")))


def run_log(spark, sf):
    out = scratch_dir(spark, "log")
    log = V.runs(spark, sf)
    metrics_of = F.create_map(F.lit("loss"), F.col("loss"), F.lit("eval_wer"), F.col("eval_wer"))
    events = log.select(F.col("event_id").alias("step"), F.col("run").alias("epoch"), metrics_of.alias("metrics"))
    for odd in (0, 1):
        logs.append_log(events.where(F.col("step") % 2 == odd), out)
    value = lambda name: r6(F.try_element_at("metrics", F.lit(name))).alias(name)
    return logs.read_run_log(spark, out).select("step", "epoch", value("loss"), value("eval_wer"))


def results_table(spark, sf):
    out, ranked = scratch_dir(spark, "results"), rank_runs(spark, sf)
    logs.write_results(ranked, out)
    return spark.read.schema(ranked.schema).json(out)


def snapshot_listing(spark, sf):
    out = scratch_dir(spark, "snapshots")
    files = V.files(spark, sf).select("run", "file_name", F.col("size").cast("string").alias("value"))
    files.repartition("run", "file_name").write.partitionBy("run", "file_name").text(out)
    found = snapshots.list_snapshots(spark, out)
    return found.groupBy("run", "dir").agg((F.sum("size") > 0).alias("has_bytes"))


def log_parse(spark, sf):
    parsed = logs.parse_log_line(F.col("props"))
    return V.table(spark, sf, "events").select("event_id", parsed["k"].alias("k"))


def artifact_size(spark, sf):
    return runs.artifact_size(V.files(spark, sf), ["run", "dir"])


# --- rows


def valid_rows(spark, sf):
    return rows.valid_rows(V.clips(spark, sf)).select("clip_id", "lang", "text")


def valid_text(spark, sf):
    return rows.valid_text_rows(V.clips(spark, sf)).select("clip_id", "lang")


def duration_filter(spark, sf):
    return rows.within_duration(V.clips(spark, sf)).select("clip_id", r6("duration").alias("duration"))


def project_prepared(spark, sf):
    return rows.project_prepared(V.clips(spark, sf), ["clip_id", "text"])


def cap_then_filter(spark, sf):
    return rows.cap_then_filter(V.clips(spark, sf), 500, rows.is_valid()).select("clip_id", "lang")


def filter_then_cap(spark, sf):
    clips = V.clips(spark, sf).select("clip_id", "pos", "text", "lang")
    return rows.filter_then_cap(clips, 500, rows.has_text(F.col("text"))).select("clip_id", "lang")


# --- order


def with_position(spark, sf):
    docs = V.table(spark, sf, "documents").select(F.col("doc_id").alias("clip_id"), "lang")
    return order.with_position(docs, "clip_id")


def file_position(spark, sf):
    return tables.read_in_file_order(spark, f"{sf}/documents.parquet").select("doc_id", "pos")


def position_in_source(spark, sf):
    docs = V.table(spark, sf, "documents").select("doc_id", "source")
    return order.number_within(docs, ["source"], "doc_id", "n")


def seeded_shuffle(spark, sf):
    placed = order.with_position(V.clips(spark, sf).select("clip_id"), "clip_id")
    return order.shuffle_bounded(placed, 256, 42, "pos", "clip_id")


def full_shuffle(spark, sf):
    return order.shuffle_full(V.clips(spark, sf).select("clip_id"), 42, "clip_id")


def repeat_epochs(spark, sf):
    return order.repeat_epochs(V.clips(spark, sf).select("clip_id"), 3, 42, "clip_id")


def assign_batches(spark, sf):
    placed = order.with_position(V.clips(spark, sf).select("clip_id"), "clip_id")
    return order.assign_batches(placed, 16)


def step_plan(spark, sf):
    placed = order.with_position(
        rows.within_duration(V.clips(spark, sf).select("clip_id", "duration")).select("clip_id"), "clip_id"
    )
    return order.step_plan(placed, batch=4, accum=4, epochs=3, max_steps=40)


def steps_per_epoch(spark, sf):
    clips = V.clips(spark, sf)
    by_batch = order.steps_per_epoch(clips, 4, 4).withColumn("form", F.lit("batches"))
    by_rows = order.steps_per_epoch(clips, 4, 4, floor_rows=True).withColumn("form", F.lit("rows"))
    return by_batch.unionByName(by_rows)


def resume_window(spark, sf):
    placed = order.with_position(V.table(spark, sf, "events").select("event_id", "event_type"), "event_id")
    return order.resume_from(placed, 300, 900)


# --- sequences


def build_vocab(spark, sf):
    return sequences.build_vocab(V.clips(spark, sf, wide=True).select("text"), VOCAB)


def _encoded(spark, sf, wrap=False, cut=sequences.MAX_LABELS):
    clips = V.clips(spark, sf, wide=True).select("clip_id", "text")
    vocab = sequences.build_vocab(V.clips(spark, sf, wide=True), VOCAB)
    return vocab, sequences.encode_text(clips, vocab, ["clip_id"], "text", cut, VOCAB, wrap)


def encode_text(spark, sf):
    _, encoded = _encoded(spark, sf)
    return encoded.select("clip_id", joined("labels").alias("labels"))


def decode_ids(spark, sf):
    vocab, encoded = _encoded(spark, sf, wrap=True, cut=256)
    ignored = F.transform("labels", lambda v, i: F.when(i % 10 == 9, A.IGNORE).otherwise(v))
    return sequences.decode_ids(encoded.withColumn("labels", ignored), vocab, ["clip_id"], vocab_size=VOCAB)


def _batched(spark, sf):
    clips = V.clips(spark, sf, wide=True).select("clip_id", "text")
    vocab = sequences.build_vocab(V.clips(spark, sf, wide=True), VOCAB)
    encoded = sequences.encode_text(clips, vocab, ["clip_id"], vocab_size=VOCAB, wrap=True)
    placed = order.assign_batches(order.with_position(V.clips(spark, sf).select("clip_id"), "clip_id"), 16)
    batches = encoded.join(placed, "clip_id")
    # every fifth batch has rows without a start id
    bare = (F.col("batch") % 5 == 0) & (F.col("in_batch") % 2 == 1)
    rest = F.slice("labels", F.lit(2), F.size("labels"))
    return batches.withColumn("labels", F.when(bare, rest).otherwise(F.col("labels")))


def pad_batch(spark, sf):
    padded = sequences.pad_to_batch_max(_batched(spark, sf))
    return padded.select("clip_id", "batch", joined("labels").alias("labels"))


def drop_common_start(spark, sf):
    padded = sequences.drop_common_start(sequences.pad_to_batch_max(_batched(spark, sf)))
    return padded.select("clip_id", "batch", joined("labels").alias("labels"))


def training_batches(spark, sf):
    clips = V.clips(spark, sf, wide=True).select("clip_id", "text", "audio")
    vocab = sequences.build_vocab(clips, VOCAB)
    out = training.training_batches(clips, vocab, "clip_id", 42, 256, 16, VOCAB)
    return out.withColumn("labels", joined("labels"))


def shift_right(spark, sf):
    padded = sequences.pad_to_batch_max(_batched(spark, sf))
    shifted = A.shift_right(F.col("labels"), sequences.START)
    return padded.withColumn("shifted", shifted).select("clip_id", joined("shifted").alias("shifted"))


def pad_mask(spark, sf):
    padded = sequences.pad_to_batch_max(_batched(spark, sf), fill=sequences.PAD)
    return padded.withColumns(
        {
            "masked": A.pad_mask(F.col("labels"), sequences.PAD),
            "mask": sequences.attention_mask(F.col("labels")),
        }
    ).select("clip_id", joined("masked").alias("masked"), joined("mask").alias("mask"))


# --- scores and losses


def topk_per_position(spark, sf):
    top = scores.top_k_per_position(V.teacher_positions(spark, sf), TOP)
    return scores.explode_top(top).withColumn("logit", r6("logit"))


def topk_wide(spark, sf):
    """The 100 best of 1,280 scores: twenty copies of the teacher's, each a quarter lower than the one before."""
    copies = F.transform(F.sequence(F.lit(0), F.lit(19)), lambda i: F.transform("teacher", lambda v: v - i / 4.0))
    wide = kept(V.teacher_positions(spark, sf).withColumn("teacher", F.flatten(copies)), "wide-scores")
    top = scores.top_k_per_position(wide, 100)
    return scores.explode_top(top).withColumn("logit", r6("logit"))


def _teacher_long(spark, sf):
    return V.teacher_positions(spark, sf).select(
        *scores.POSITION, F.posexplode("teacher").alias("token_id", "logit")
    )


def topk_long(spark, sf):
    return scores.top_k_long(_teacher_long(spark, sf), TOP).withColumn("logit", r6("logit"))


def softmax_t(spark, sf):
    p = A.softmax(F.col("teacher"), 2.0)
    return V.teacher_positions(spark, sf).select(*scores.POSITION, F.posexplode(p).alias("token_id", "p")).withColumn("p", r6("p"))


def log_softmax_t(spark, sf):
    p = A.log_softmax(F.col("teacher"), 2.0)
    return V.teacher_positions(spark, sf).select(*scores.POSITION, F.posexplode(p).alias("token_id", "log_p")).withColumn("log_p", r6("log_p"))


def topk_renorm(spark, sf):
    top = scores.top_k_per_position(V.teacher_positions(spark, sf), TOP)
    p = A.top_k_renorm(F.col("top"), 1.0)
    return top.select(*scores.POSITION, F.posexplode(p).alias("r", "p")).select(
        *scores.POSITION, (F.col("r") + 1).alias("rank"), r6("p").alias("p")
    )


def vocab_align(spark, sf):
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v)
    return scores.vocab_aligned(V.scores(spark, sf)).select(
        *scores.POSITION,
        F.size("teacher").alias("n_teacher"),
        F.size("student").alias("n_student"),
        r6(total("teacher")).alias("sum_teacher"),
        r6(total("student")).alias("sum_student"),
    )


def loss_mask(spark, sf):
    return V.teacher_positions(spark, sf).select(*scores.POSITION, A.is_scored(F.col("label_id")).alias("scored"))


def align_scores(spark, sf):
    examples = rows.valid_rows(V.clips(spark, sf)).select(F.col("pos").alias("example_pos"), "lang")
    top = scores.top_k_per_position(V.teacher_positions(spark, sf), TOP)
    return scores.align_scores(examples, top).select(
        *scores.POSITION, "lang", "label_id", r6(F.col("top")[0]["logit"]).alias("best_logit")
    )


def align_bucketed(spark, sf):
    """Scores and examples stored in buckets of positions meet without a shuffle below the join."""
    names = [f"voxframe_{uuid.uuid4().hex}" for _ in range(2)]
    examples = rows.valid_rows(V.clips(spark, sf)).select(F.col("pos").alias("example_pos"), "lang")
    top = scores.top_k_per_position(V.teacher_positions(spark, sf), TOP)
    for name, df in zip(names, (examples, top)):
        stored.write_bucketed(df, name, 16)
    return scores.align_scores(*[spark.table(name).hint("merge") for name in names]).select(
        *scores.POSITION, "lang", "label_id", r6(F.col("top")[0]["logit"]).alias("best_logit")
    )


def align_packed(spark, sf):
    examples = rows.valid_rows(V.clips(spark, sf)).select(F.col("pos").alias("example_pos"), "text")
    top = scores.top_k_per_position(V.teacher_positions(spark, sf), TOP)
    aligned = scores.align_scores(examples, scores.pack_positions(top))
    best = F.transform("positions", lambda p: F.element_at(p["top"], 1)["token_id"])
    return aligned.withColumn("best", best).select("example_pos", "text", joined("best").alias("best"))


def gather_topk(spark, sf):
    top = scores.top_k_long(_teacher_long(spark, sf), TOP)
    student = scores.kept_log_probabilities(top, V.scores(spark, sf))
    return scores.gather_top(top, student).select(
        *scores.POSITION, "rank", "token_id", r6("logit").alias("logit"), r6("log_q").alias("log_q")
    )


def gather_topk_array(spark, sf):
    pos = scores.vocab_aligned(V.scores(spark, sf))
    top = scores.top_k_per_position(pos, TOP)
    ids = F.transform("top", lambda e: e["token_id"])
    log_q = A.gather(A.log_softmax(F.col("student")), ids)
    return top.select(*scores.POSITION, F.posexplode(F.arrays_zip(ids.alias("token_id"), log_q.alias("log_q"))).alias("r", "e")).select(
        *scores.POSITION, (F.col("r") + 1).alias("rank"), F.col("e.token_id").alias("token_id"), r6("e.log_q").alias("log_q")
    )


def cross_entropy(spark, sf):
    ce = A.cross_entropy(F.col("student"), F.col("label_id"))
    per = V.scores(spark, sf).select(ce.alias("ce"), A.is_scored(F.col("label_id")).alias("scored"))
    return per.agg(F.count_if("scored").alias("positions"), r6(scores.masked_mean(F.col("ce"), F.col("scored"))).alias("ce"))


def _terms(spark, sf, k):
    return scores.loss_terms(V.scores(spark, sf), k, TEMPERATURES)


def kl_full(spark, sf):
    return _terms(spark, sf, None).select("temperature", "positions", r6("kl").alias("kl"))


def kl_topk(spark, sf):
    return _terms(spark, sf, TOP).select("temperature", "positions", r6("kl").alias("kl"))


def _loss(terms):
    return scores.combined_loss(terms, ALPHAS).select(
        "alpha", "temperature", "positions", r6("ce").alias("ce"), r6("kl").alias("kl"), r6("loss").alias("loss")
    )


def combined_loss(spark, sf):
    return _loss(_terms(spark, sf, TOP))


def combined_loss_full(spark, sf):
    return _loss(_terms(spark, sf, None))


def stored_loss(spark, sf):
    out = scratch_dir(spark, "teacher-scores")
    stored.write_teacher_scores(scores.top_k_per_position(V.teacher_positions(spark, sf), TOP), out)
    student = V.scores(spark, sf).select(*scores.POSITION, "student")
    both = student.join(stored.read_teacher_scores(spark, out), scores.POSITION)
    return _loss(scores.stored_loss_terms(both, TEMPERATURES))


def vector_mse(spark, sf):
    layers = lambda c: F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.slice(c, i * 21 + 1, 21))
    mse = A.vector_mse(layers(F.col("teacher")), layers(F.col("student")))
    per = V.scores(spark, sf).select(*scores.POSITION, mse.alias("mse"))
    return per.groupBy("example_pos").agg(r6(scores.mean_or_nan(F.col("mse"))).alias("mse"))


def storage_per_row(spark, sf):
    df = V.teacher_positions(spark, sf)
    out = scores.storage_per_row(df, 100, 51_865, F.lit(1))
    return out.select("examples", "positions", r6("top_bytes_per_row").alias("top_bytes_per_row"), r6("full_bytes_per_row").alias("full_bytes_per_row"))


def pad_or_trim(spark, sf):
    fixed = lambda n: A.pad_or_trim(F.col("teacher"), n)
    wide = V.teacher_positions(spark, sf).select(
        *scores.POSITION,
        F.posexplode(F.when(F.col("example_pos") % 2 == 0, fixed(80)).otherwise(fixed(48))).alias("i", "v"),
    )
    return wide.withColumn("v", r6("v"))


def truncate_context(spark, sf):
    n = F.when(F.col("label") == 9, 1500).otherwise(F.col("label") * 3 + 1)
    feature = F.array(F.slice("embedding", 1, 32), F.slice("embedding", 33, 32)).cast("array<array<double>>")
    cut = V.table(spark, sf, "embeddings").select("vec_id", A.truncate_context(feature, n).alias("f"))
    total = F.aggregate(F.flatten("f"), F.lit(0.0), lambda s, v: s + v)
    return cut.select("vec_id", F.size("f").alias("bins"), F.size(F.col("f")[0]).alias("frames"), r6(total).alias("total"))


# --- word error rate


def word_edits(spark, sf):
    return metrics.word_edits(V.pairs(spark, sf)).select("model", "clip_id", "edits", "ref_words")


def split_edits(spark, sf):
    found = metrics.split_edits(V.pairs(spark, sf))
    return found.select("model", "clip_id", "changes.substitutions", "changes.deletions", "changes.insertions", "ref_words")


def wer_corpus(spark, sf):
    return metrics.wer_corpus(V.pairs(spark, sf)).withColumn("wer", r6("wer"))


def wer_by_model(spark, sf):
    return metrics.wer_by_model(V.pairs(spark, sf), "seconds").withColumns({"wer": r6("wer"), "elapsed_s": r6("elapsed_s")})


def wer_at_n(spark, sf):
    clips = rows.valid_text_rows(V.clips(spark, sf, wide=True).select("clip_id", "text"))
    pos = order.with_position(clips.select("clip_id"), "clip_id")
    placed = V.hypotheses(clips.join(pos, "clip_id")).withColumnRenamed("text", "ref")
    return metrics.wer_at_n(placed, [200, 2000, 0]).withColumn("wer", r6("wer"))


def zip_pairs(spark, sf):
    refs = V.clips(spark, sf).select("clip_id", F.col("text").alias("ref"))
    hyps = V.pairs(spark, sf).select("clip_id", "model", "hyp")
    return metrics.zip_pairs(refs, hyps, ["clip_id"]).select(
        "clip_id", "model", F.length("ref").alias("ref_chars"), F.size(tokens(F.col("hyp"))).alias("hyp_words")
    )


def vs_baseline(spark, sf):
    by_lang = metrics.word_edits(
        V.hypotheses(V.clips(spark, sf, wide=True).select("clip_id", "lang", "text")).withColumnRenamed("text", "ref")
    )
    table = by_lang.groupBy("model", "lang").agg(metrics.wer().alias("wer"))
    before = table.where(F.col("model") == 3).select(F.col("lang").alias("model"), "wer")
    after = table.where(F.col("model") == 2).select(F.col("lang").alias("model"), "wer")
    return metrics.vs_baseline(after, before).select(
        "model",
        r6("wer_before").alias("wer_before"),
        r6("wer_after").alias("wer_after"),
        r6("relative_reduction").alias("relative_reduction"),
    )


# --- runs and files


def last_metric(spark, sf):
    return runs.last_metric(V.runs(spark, sf)).withColumn("last", r6("last"))


def best_step(spark, sf):
    return runs.best_step(V.runs(spark, sf)).withColumn("best", r6("best"))


def quality_filter(spark, sf):
    marks = V.table(spark, sf, "labels").select(
        "doc_id", (F.col("quality") == 0).alias("noisy"), (F.col("toxic") == 1).alias("multiple_speakers"))
    flagged = V.table(spark, sf, "documents").select("doc_id", "lang").join(marks, "doc_id", "left")
    return rows.quality_filter(flagged).select("doc_id", "lang")


def skip_sources(spark, sf):
    skipped = spark.createDataFrame([("src3", "machine text"), ("src7", "no licence")], "source string, reason string")
    return rows.skip_sources(V.table(spark, sf, "documents").select("doc_id", "source"), skipped).select("doc_id", "source")


def argmax_label(spark, sf):
    return V.table(spark, sf, "embeddings").select("vec_id", A.argmax_label(F.col("embedding")).alias("label_id"))


def final_vs_best(spark, sf):
    out = runs.final_vs_best(V.runs(spark, sf))
    return out.withColumns({c: r6(c) for c in ("last", "best", "regression")})


def running_mean(spark, sf):
    log = kept(V.runs(spark, sf).select("run", "step", "loss"), "log")  # numbered once
    return runs.running_mean(log, 20).withColumn("mean", r6("mean"))


def throughput(spark, sf):
    log = kept(V.runs(spark, sf).select("run", "step", "seconds", "event_type"), "log")
    out = runs.throughput(log, 16, valid=F.col("event_type") != "error")
    return out.withColumns({"s_per_row": r6("s_per_row"), "rows_per_min": r6("rows_per_min")})


def rank_runs(spark, sf):
    log = V.runs(spark, sf)
    cells = log.groupBy("run", "alpha", "temperature").agg(
        F.max_by("eval_wer", F.when(F.col("eval_wer").isNotNull(), F.col("step"))).alias("wer")
    )
    ranked = metrics.rank_runs(cells, ["alpha", "temperature"])
    return ranked.withColumn("wer", r6("wer"))


def grid(spark, sf):
    seen = V.table(spark, sf, "events").select((F.col("user_id") % 6).cast("int").alias("run"), "event_type")
    run_of = (F.array_position(F.array(*map(F.lit, ALPHAS)), F.col("alpha")) - 1) * 2 + F.array_position(
        F.array(*map(F.lit, TEMPERATURES)), F.col("temperature")
    ) - 1
    counts = seen.groupBy("run").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("event_type") == "purchase").alias("evals"))
    cells = sweep_grid(spark.range(1).select(), alpha=ALPHAS, temperature=TEMPERATURES)
    return (
        cells.withColumn("run", run_of.cast("int"))
        .join(counts, "run", "left")
        .select("alpha", "temperature", "run", F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("evals", F.lit(0)).alias("evals"))
    )


def is_complete(spark, sf):
    out = runs.is_complete(V.files(spark, sf), ["run", "dir"])
    return out.withColumn("missing", joined("missing"))


def retain_latest(spark, sf):
    return runs.retain_latest(V.files(spark, sf), 3)


def latest_snapshot(spark, sf):
    explicit = F.when(F.col("run") == 2, "checkpoint-500").when(F.col("run") == 4, "checkpoint-gone")
    return runs.latest_snapshot(V.files(spark, sf), explicit)


def state_or_name(spark, sf):
    saved = F.when(F.col("file_name") == "optimizer.pt", F.col("event_id"))
    df = V.files(spark, sf).select(
        "event_id", "dir", saved.alias("state_step"), whole_div(saved, 100).alias("state_epoch")
    )
    return runs.state_or_name(df, 1000).select("event_id", "step", "epoch")


def label_of_run(spark, sf):
    path = F.concat(F.lit("out/run-"), F.col("run").cast("string"), F.lit("/"), F.col("dir"))
    df = V.files(spark, sf).select("event_id", run_label(path, F.col("run") != 3).alias("label"))
    return df


# --- audio and user functions


def context_size(spark, sf):
    d = F.col("duration")
    return V.clips(spark, sf).select(
        "clip_id",
        context_frames(d).alias("n_ctx"),
        context_frames(d / 10, F.col("clip_id"), 7).alias("n_ctx_jitter"),
    )


def map_rows(spark, sf):
    def measure(batch: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(
            {
                "clip_id": batch["clip_id"],
                "n_words": batch["text"].str.split().str.len(),
                "n_upper": batch["text"].str.count("[A-Z]"),
            }
        )

    clips = rows.valid_text_rows(V.clips(spark, sf, wide=True))
    return inference.map_rows(clips, measure, "clip_id long, n_words long, n_upper long", ["clip_id", "text"])


def batch_predict(spark, sf):
    def make_model():
        import numpy as np

        weights = (np.arange(64) % 7 - 3) / 4.0
        return lambda x: x.astype(np.float64) @ weights

    df = V.table(spark, sf, "embeddings").select("vec_id", "embedding")
    scored = inference.batch_predict(df, make_model, ["embedding"], "score", DoubleType(), 256, [[64]])
    return scored.select("vec_id", r6("score").alias("score"))


def clip_seconds(spark, sf):
    return V.waves(spark, sf).select("clip_id", F.round(clip_duration(F.col("audio.array")), 7).alias("duration"))


def _feature_rows(df):
    flat = F.flatten("features")
    total = F.aggregate(flat, F.lit(0.0), lambda s, v: s + v)
    return inference.clip_features(df, "clip_id", precision="double").select(
        "clip_id",
        F.round("duration", 7).alias("duration"),
        "n_frames",
        F.round(total / F.size(flat), 5).alias("mean"),
        F.round(F.array_max(flat), 5).alias("top"),
        F.round("fill", 5).alias("fill"),
    )


def clip_features(spark, sf):
    return _feature_rows(V.waves(spark, sf))


def resampled_features(spark, sf):
    return _feature_rows(V.waves(spark, sf, 44_100))


# --- several sources, generated labels


def harmonise_union(spark, sf):
    docs = V.table(spark, sf, "documents").select("doc_id", "text", "lang")
    turns = V.table(spark, sf, "conversations").select("conv_id", F.col("text").alias("content"), "role")
    return combining.harmonise([(docs, {"doc_id": "clip_id"}), (turns, {"conv_id": "clip_id", "content": "text"})])


def interleave(spark, sf):
    docs = V.table(spark, sf, "documents").select("doc_id", "lang")
    return combining.interleave(docs, {"fr": 7, "de": 3}, "doc_id", "lang")


def interleave_seeded(spark, sf):
    docs = V.table(spark, sf, "documents").select("doc_id", "lang")
    return combining.interleave(docs, {"fr": 7, "de": 3}, "doc_id", "lang", seed=42)


def merge_labelled(spark, sf):
    docs = V.table(spark, sf, "documents").select(F.col("doc_id").alias("clip_id"), "text")
    turns = V.table(spark, sf, "conversations").select(F.col("conv_id").alias("clip_id"), "text")
    return combining.merge_labelled(docs, turns, "clip_id")


def _used(spark, sf):
    """Every line of every document in another dress, every turn and every benchmark item."""
    line = F.explode(F.split("text", "\n"))
    docs = V.table(spark, sf, "documents").select(line.alias("line")).select(F.concat(F.lit(" "), "line", F.lit(" !?")).alias("text"))
    others = [V.table(spark, sf, name).select("text") for name in ("conversations", "benchmark")]
    return docs.unionByName(others[0]).unionByName(others[1])


def only_new_rows(spark, sf):
    return combining.only_new_rows(V.table(spark, sf, "documents").select("doc_id", "text"), _used(spark, sf)).select("doc_id")


def overlap_rows(spark, sf):
    return combining.overlap_rows(V.table(spark, sf, "documents").select("doc_id", "text"), _used(spark, sf)).select("doc_id")


def source_profile(spark, sf):
    out = combining.source_profile(V.clips(spark, sf))
    return out.withColumns({c: r6(c) for c in ("hours", "mean_seconds")})


def wer_normalised(spark, sf):
    """Every seventh word is wrong, every fifth of the others has marks that normalising takes away."""
    words = F.transform("words", lambda w, i: F.when((i + 1) % 7 == 0, V.SUBSTITUTE)
                        .when((i + 1) % 5 == 0, F.concat(w, F.lit("?!"))).otherwise(w))
    pairs = V.table(spark, sf, "documents").select("lang", tokens(F.col("text")).alias("words")).select(
        F.col("lang").alias("model"), F.array_join("words", " ").alias("ref"), F.array_join(words, " ").alias("hyp"))
    out = metrics.wer_normalised(pairs)
    return out.withColumns({c: r6(c) for c in ("wer_raw", "wer_normalised")})


def repetition_score(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id", r6(repetition(F.col("text"))).alias("score"))


def _outputs(spark, sf):
    marked = F.when(F.col("doc_id") % 19 == 0, F.concat("text", F.lit(f" {pseudo.BLANK_AUDIO}"))).otherwise(F.col("text"))
    slow = F.when(F.col("doc_id") % 7 == 0, 20.0).otherwise(1.0)
    return V.table(spark, sf, "documents").select(
        F.col("doc_id").alias("clip_id"), marked.alias("text"), (F.col("n_chars") / 15.0 * slow).alias("duration"))


def pseudo_filter(spark, sf):
    return pseudo.pseudo_label_filter(_outputs(spark, sf)).select("clip_id")


def pseudo_label(spark, sf):
    """A third of the documents has no label; the model's output for it is its text with a mark at times."""
    third = F.col("clip_id") % 3 == 0
    clips = _outputs(spark, sf).select(
        "clip_id", F.col("text").alias("heard"), F.when(~third, F.col("text")).alias("text"), "duration")
    done = pseudo.pseudo_label(clips, lambda df: df.withColumn("text", F.col("heard")), scratch_dir(spark, "pseudo-labels"), "clip_id")
    return done.select("clip_id", F.length("text").alias("chars"), "supervised")


def topk_mass(spark, sf):
    found = scores.top_k_mass(V.scores(spark, sf), TOP)
    return found.select(*scores.POSITION, r6("kept").alias("kept"), r6("outside").alias("outside"))


def loss_balance(spark, sf):
    out = scores.loss_balance(scores.combined_loss(_terms(spark, sf, TOP), ALPHAS))
    return out.select("alpha", "temperature", r6("kl_to_ce").alias("kl_to_ce"), r6("kl_share").alias("kl_share"))


def js_divergence(spark, sf):
    js = A.js_divergence(F.col("teacher"), F.col("student"))
    return V.scores(spark, sf).select(*scores.POSITION, r6(js).alias("js"))


def regression_alarm(spark, sf):
    log = V.runs(spark, sf)
    start = log.groupBy("run").agg(F.avg("eval_wer").alias("wer"))
    out = runs.regression_alarm(log, start)
    return out.withColumns({c: r6(c) for c in ("wer_start", "first_wer")})


REGISTERED: dict[str, Query] = {
    f.__name__: f
    for f in (
        scan_split, stream_valid_clips, topk_roundtrip, log_parse, artifact_size,
        optional_split, stream_scores, scores_in_parts, stream_progress, stream_shuffle, stream_buffers, score_source, run_log, results_table,
        snapshot_listing,
        valid_rows, valid_text, duration_filter, project_prepared, cap_then_filter, filter_then_cap,
        with_position, file_position, position_in_source, seeded_shuffle, full_shuffle, repeat_epochs,
        assign_batches, step_plan, steps_per_epoch, resume_window,
        build_vocab, encode_text, decode_ids, pad_batch, drop_common_start, training_batches, shift_right, pad_mask,
        topk_per_position, topk_wide, topk_long, softmax_t, log_softmax_t, topk_renorm, vocab_align, loss_mask,
        align_scores, align_packed, align_bucketed, gather_topk, gather_topk_array, cross_entropy, kl_full, kl_topk, combined_loss,
        combined_loss_full, stored_loss, vector_mse, storage_per_row, pad_or_trim, truncate_context,
        word_edits, split_edits, wer_corpus, wer_by_model, wer_at_n, zip_pairs, vs_baseline,
        last_metric, best_step, final_vs_best, quality_filter, skip_sources, argmax_label, running_mean, throughput, rank_runs, grid,
        is_complete, retain_latest, latest_snapshot, state_or_name, label_of_run,
        context_size, map_rows, batch_predict, clip_seconds, clip_features, resampled_features,
        harmonise_union, interleave, interleave_seeded, merge_labelled, only_new_rows, overlap_rows, source_profile, wer_normalised,
        repetition_score, pseudo_filter, pseudo_label, topk_mass, loss_balance, js_divergence, regression_alarm,
    )
}
