"""The operators applied to the driver's tables, one function per query key.

Every function takes ``(spark, sf_dir)`` and runs over whole tables. The tables
play these parts: ``documents`` is the corpus as it is now; an earlier run knew
the documents that have a label, in another revision where the quality label is
0, and the pages, which are gone since; ``benchmark`` holds questions;
``conversations`` holds sessions and generated texts; ``events`` holds latencies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.answers import build_prompt
from ..functions.text import content_hash as hash_of
from ..functions.text import normalize_newlines
from ..functions.text import normalize_tokens as tokens_of
from ..functions.vectors import cosine_distance as distance_of
from ..operators import adaptive, answering, cells, diff, embedding, hooks, postings, retrieval, sessions
from ..operators.chunking import chunk_text as chunk
from ..schemas import AdaptiveOptions
from ..session import scratch_dir, spread
from ..sources import files, history, markdown, markup
from ..sources.state import Collection, read_manifest
from ..sources.state import ensure_index as ensure_table
from ..streaming.budget import budget_controller_stream as budget_stream
from ..streaming.budget import latest_budgets
from ..streaming.ingest import streaming_ingest as ingest_stream
from . import ask
from .ingest import incremental_ingest as ingest

BEFORE, NOW = "2024-01-01", "2024-02-01"
LATENCY = AdaptiveOptions(latency_target=50.0)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def at(day: str) -> Column:
    """Midnight of a day in the session's time zone."""
    return F.to_timestamp(F.lit(f"{day} 00:00:00"))


def doc_path(suffix: str = "") -> Column:
    return F.concat(F.lit("doc/"), F.col("doc_id"), F.lit(suffix))


def page_path(suffix: str = "") -> Column:
    return F.concat(F.lit("page/"), F.col("page_id"), F.lit(suffix))


def documents(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select(doc_path().alias("file_path"), "text")


def pages(spark, sf) -> DataFrame:
    return table(spark, sf, "pages").select(page_path().alias("file_path"), F.col("html").alias("text"))


def labelled(spark, sf) -> DataFrame:
    return table(spark, sf, "labels").select(doc_path().alias("file_path"), "quality", "toxic")


def questions(spark, sf) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def current(spark, sf) -> DataFrame:
    return documents(spark, sf).select(
        "file_path", hash_of(F.col("text")).alias("content_hash"), at(NOW).alias("modified_at")
    )


def earlier(spark, sf) -> DataFrame:
    """``(file_path, text)`` as the earlier run saw it."""
    docs = spread(documents(spark, sf)).join(labelled(spark, sf), "file_path")
    old = F.when(F.col("quality") == 0, F.concat("text", F.lit(" (draft)"))).otherwise(F.col("text"))
    return docs.select("file_path", old.alias("text")).unionByName(spread(pages(spark, sf)))


def manifest(spark, sf) -> DataFrame:
    return earlier(spark, sf).select(
        "file_path", hash_of(F.col("text")).alias("content_hash"),
        at(BEFORE).alias("last_modified"), at(BEFORE).alias("created_at"),
    )


def chunks(spark, sf) -> DataFrame:
    return chunk(spread(documents(spark, sf)))


def corpus(texts: DataFrame, suffix: str, when: str) -> DataFrame:
    content = F.encode("text", "UTF-8")
    return texts.select(
        F.concat("file_path", F.lit(suffix)).alias("file_path"), F.lit(suffix).alias("suffix"),
        at(when).alias("modified_at"), F.length(content).cast("bigint").alias("length"),
        content.alias("content"),
    )


# hashing and comparison


def content_hash(spark, sf):
    return documents(spark, sf).select("file_path", hash_of(F.col("text")).alias("content_hash"))


def snapshot_diff(spark, sf):
    return diff.snapshot_diff(current(spark, sf), manifest(spark, sf)).drop("modified_at")


def new_files(spark, sf):
    return diff.new_files(current(spark, sf), manifest(spark, sf))


def deleted_files(spark, sf):
    return diff.deleted_files(current(spark, sf), manifest(spark, sf))


def modified_files(spark, sf):
    return diff.modified_files(current(spark, sf), manifest(spark, sf))


def ingest_report(spark, sf):
    return diff.ingest_report(snapshot_diff(spark, sf))


def _readable(df: DataFrame) -> DataFrame:
    stamps = [f.name for f in df.schema if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType))]
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in stamps})


def manifest_upsert(spark, sf):
    delta = current(spark, sf).withColumnRenamed("modified_at", "last_modified")
    return _readable(diff.manifest_upsert(manifest(spark, sf), delta, at(NOW)))


def manifest_delete(spark, sf):
    gone = diff.deleted_files(current(spark, sf), manifest(spark, sf))
    return _readable(diff.manifest_delete(manifest(spark, sf), gone))


def manifest_lookup(spark, sf):
    found = diff.lookup(manifest(spark, sf), documents(spark, sf), ["content_hash", "last_modified"])
    return _readable(found)


# chunks and the vector table


def chunk_text(spark, sf):
    return chunks(spark, sf)


def chunk_keys(spark, sf):
    cut = chunk(spread(pages(spark, sf)), chunk_size=300, overlap=50)
    return cut.select("chunk_id", "file_path", F.length("text").alias("n_chars"))


def delete_chunks_by_file(spark, sf):
    toxic = labelled(spark, sf).filter("toxic = 1")
    return retrieval.delete_chunks_by_file(chunks(spark, sf), toxic).select("chunk_id", "file_path")


def delete_chunks_by_id(spark, sf):
    heads = labelled(spark, sf).select(F.concat("file_path", F.lit("::0")).alias("chunk_id"))
    return retrieval.delete_chunks_by_id(chunks(spark, sf), heads).select("chunk_id", "file_path")


def vector_append(spark, sf):
    known = chunk(spread(documents(spark, sf).join(labelled(spark, sf), "file_path")))
    known = known.withColumn("origin", F.lit("stored"))
    new = chunks(spark, sf).withColumn("origin", F.lit("added"))
    return retrieval.vector_append(known, new).select("chunk_id", "file_path", "origin")


def replace_chunks(spark, sf):
    poor = documents(spark, sf).join(labelled(spark, sf).filter("quality = 0"), "file_path")
    new = chunk(poor, chunk_size=400, overlap=40)
    replaced = retrieval.replace_chunks(chunks(spark, sf), new)
    return replaced.select("chunk_id", "file_path", "start", F.length("text").alias("n_chars"))


def incremental_ingest(spark, sf):
    state = scratch_dir(spark, "ingest")
    ingest(spark, corpus(earlier(spark, sf), ".txt", BEFORE), state, now=at(BEFORE))
    ingest(spark, corpus(spread(documents(spark, sf)), ".txt", NOW), state, now=at(NOW))
    return Collection(spark, state).chunks().select("chunk_id", "file_path", "chunk_no", "start", "text")


def collection_edits(spark, sf):
    """Chunks of a stored collection after each of three edits: by file, by id, and appended again."""
    place = scratch_dir(spark, "edits")
    ingest(spark, corpus(spread(documents(spark, sf)), ".txt", NOW), place, now=at(NOW))
    marks = table(spark, sf, "labels").select(doc_path(".txt").alias("file_path"), "quality", "toxic")
    toxic, poor = marks.filter("toxic = 1"), marks.filter("quality = 0")
    first = Collection(spark, place).vectors().filter("chunk_no = 0")
    taken = first.join(toxic, "file_path", "left_semi")
    states = []

    def edit(number, change) -> None:
        change(Collection(spark, place))
        states.append(Collection(spark, place).chunks().select(F.lit(number).alias("step"), "chunk_id", "file_path"))

    edit(1, lambda c: c.delete_by_file(toxic))
    edit(2, lambda c: c.delete_by_id(first.join(poor, "file_path", "left_semi").select("chunk_id")))
    edit(3, lambda c: c.append(taken.unionByName(taken)))
    return states[0].unionByName(states[1]).unionByName(states[2])


def _weights(collection: Collection) -> DataFrame:
    """The vectors of a collection, as weights per feature bucket."""
    rows = collection.vectors().select("chunk_id", F.posexplode("embedding").alias("bucket", "weight"))
    return rows.filter("weight <> 0").select("chunk_id", "bucket", F.round(F.col("weight").cast("double"), 6).alias("weight"))


def ingest_vectors(spark, sf):
    """Vectors after two runs: weighed by the chunks that are live at the end, not by those of the first run."""
    place = scratch_dir(spark, "vectors")
    ingest(spark, corpus(earlier(spark, sf), ".txt", BEFORE), place, now=at(BEFORE))
    ingest(spark, corpus(spread(documents(spark, sf)), ".txt", NOW), place, now=at(NOW))
    return _weights(Collection(spark, place))


def manifest_source(spark, sf):
    state = scratch_dir(spark, "manifest")
    ingest(spark, corpus(earlier(spark, sf), ".txt", BEFORE), state, now=at(BEFORE))
    ingest(spark, corpus(spread(documents(spark, sf)), ".txt", NOW), state, now=at(NOW))
    return _readable(read_manifest(spark, state))


# loaders


def _folder(spark, sf) -> str:
    """A folder with one text file per document, below a folder named after its id.

    Ids that end in the same two digits share a folder above theirs, so that a listing is dealt out by these.
    """
    place = scratch_dir(spark, "folder")
    texts = table(spark, sf, "documents").select("doc_id", "text")
    files.write_files(texts.withColumn("shelf", F.substring(F.col("doc_id").cast("string"), -2, 2)), place, ["shelf", "doc_id"])
    return place


def scan_corpus(spark, sf):
    """Every file of a folder: the number in its path, suffix, length and hash."""
    rows = files.scan_corpus(spark, _folder(spark, sf))
    number = F.regexp_extract("file_path", "doc_id=([0-9]+)/", 1).cast("bigint")
    return rows.select(number.alias("doc_id"), "suffix", "length", hash_of(F.col("content")).alias("content_hash"))


def ensure_index(spark, sf):
    """Chunks of a collection that is made sure of before, between and after two ingests of a folder.

    The second ingest sees two thirds of the files; the others count as deleted.
    """
    place, out = _folder(spark, sf), scratch_dir(spark, "index")
    third = "shelf=*[0134679]"
    seen = []
    for step, glob in enumerate((None, "*", third)):
        if glob:
            ingest(spark, files.Folder(spark, f"{place}/{glob}"), out, now=at(NOW))
        rows = ensure_table(spark, out)
        seen.append(rows.select(F.lit(step).alias("step"), F.regexp_extract("file_path", "doc_id=([0-9]+)/", 1).cast("bigint").alias("doc_id"), "chunk_no"))
    return seen[0].unionByName(seen[1]).unionByName(seen[2])


def markdown_html(spark, sf):
    """Every part as a Markdown text with each construct that is rendered."""
    text = F.concat(
        F.lit("# Part "), "p_partkey", F.lit(" #\n\nThe `a*"), "p_size", F.lit("*b <i>` of **"), "p_name", F.lit("** is _"), "p_brand",
        F.lit("_ <b>here</b>, x_y_z & 3 < 4 \\*plain\\*\nnext line\n\n- one\n    - "), "p_type", F.lit("\n        1. deep *"), "p_name",
        F.lit("*\n    - two\n- three\n\nKinds\n-----\n\n1. [to](http://x/p_"), "p_partkey", F.lit("_q)\n2. ![pic](i.png)\n\n```sql\n# "), "p_name",
        F.lit(" *not* <read>\n```\n<div>\n*raw* "), "p_name", F.lit("\n</div>\n\n> said "), "p_brand", F.lit("\n\n***\n\n    kept <as> is"),
    )
    parts = spread(table(spark, sf, "part"))
    return parts.select("p_partkey", markdown.markdown_html(text).alias("html"))


def load_csv(spark, sf):
    texts = documents(spark, sf).unionByName(pages(spark, sf))
    loaded = spread(texts).select("file_path", files.csv_content(normalize_newlines(F.col("text"))).alias("text"))
    return loaded


def markup_blocks(spark, sf):
    return markup.markup_blocks(spread(documents(spark, sf)))


def html_text(spark, sf):
    return markup.markup_blocks(spread(pages(spark, sf)), flavour="html")


def _mixed(spark, sf) -> DataFrame:
    """Files of every kind, good and bad, made from the tables."""
    bench = table(spark, sf, "benchmark").select(
        F.concat(F.lit("item/"), "item_id").alias("file_path"),
        F.concat(F.lit("# Item "), "item_id", F.lit("\n\n"), "text", F.lit("\n\n* from the benchmark\n* one item\n"))
        .alias("text"),
    )
    parts = table(spark, sf, "part").select(
        F.concat(F.lit("part/"), "p_partkey").alias("file_path"),
        F.concat(
            F.lit("name,kind,size\n"), "p_name", F.lit(',"'), "p_type", F.lit(", "), "p_brand",
            F.lit('",'), "p_size", F.lit("\n"),
        ).alias("text"),
    )
    bad = documents(spark, sf).select(
        F.concat("file_path", F.lit(".bad")).alias("file_path"), "text"
    )
    cut = corpus(bad, ".txt", NOW).withColumn("content", F.concat("content", F.lit(b"\xff\xfe")))
    return (
        corpus(documents(spark, sf), ".TXT", NOW)
        .unionByName(corpus(bench, ".md", NOW))
        .unionByName(corpus(parts, ".csv", NOW))
        .unionByName(corpus(pages(spark, sf), ".html", NOW))
        .unionByName(corpus(pages(spark, sf), ".pdf", NOW))
        .unionByName(cut)
    )


def load_documents(spark, sf):
    return files.load_documents(_mixed(spark, sf))


def quarantine(spark, sf):
    return files.quarantine(files.load_documents(_mixed(spark, sf)))


# vectors


def vectors(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings")


def centroids(spark, sf) -> DataFrame:
    """The mean vector of every label, as questions."""
    parts = vectors(spark, sf).select("label", F.posexplode("embedding").alias("i", "x"))
    means = parts.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    ordered = F.array_sort(F.collect_list(F.struct("i", "x")))
    return means.groupBy("label").agg(F.transform(ordered, lambda p: p["x"]).alias("embedding")).select(
        F.col("label").alias("query_id"), "embedding"
    )


def embedding_dimension(spark, sf):
    return embedding.embedding_dimension(vectors(spark, sf))


def cosine_distance(spark, sf):
    own = vectors(spark, sf).join(
        centroids(spark, sf).select(F.col("query_id").alias("label"), F.col("embedding").alias("centroid")), "label"
    )
    distance = distance_of(F.col("embedding"), F.col("centroid"))
    return own.select("vec_id", "label", F.round(distance, 6).alias("distance"))


def _rounded(hits: DataFrame) -> DataFrame:
    return hits.withColumn("distance", F.round("distance", 6))


def topk_by_vector(spark, sf):
    parts = vectors(spark, sf).select(F.posexplode("embedding").alias("i", "x"))
    mean = parts.groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("x")).orderBy("i").collect()
    return _rounded(
        retrieval.topk_by_vector(vectors(spark, sf), [r["x"] for r in mean], 10, id_col="vec_id", carry=("label",))
    )


def topk_batch(spark, sf):
    asked = vectors(spark, sf).select(F.col("vec_id").alias("query_id"), "embedding")
    return _rounded(retrieval.topk_batch(vectors(spark, sf), asked, 4, id_col="vec_id", carry=("label",)))


def metadata_filter_topk(spark, sf):
    hits = retrieval.topk_batch(
        vectors(spark, sf), centroids(spark, sf), 4, F.col("label") == 3, id_col="vec_id", carry=("label",)
    )
    return _rounded(hits)


def twentieths(spark, sf) -> DataFrame:
    """Every twentieth vector, as questions."""
    return vectors(spark, sf).where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def approx_topk(spark, sf):
    path = scratch_dir(spark, "cells")
    return _rounded(cells.approx_topk(vectors(spark, sf), twentieths(spark, sf), path, id_col="vec_id"))


def topk_blocks(spark, sf):
    """Exact search with more questions than one task may hold: both sides in blocks."""
    asked = vectors(spark, sf).select(F.col("vec_id").alias("query_id"), "embedding")
    small = {"block_bytes": 8 * 64 * 100, "group_rows": 300}
    return _rounded(retrieval.topk_batch(vectors(spark, sf), asked, 4, id_col="vec_id", carry=("label",), **small))


def fit_idf(spark, sf):
    model = embedding.fit_idf(chunks(spark, sf))
    return model.to_df(spark).withColumn("idf", F.round("idf", 9))


def hashed_embedding(spark, sf):
    cut = chunks(spark, sf)
    made = embedding.hashed_embedding(cut, embedding.fit_idf(cut))
    long = made.select("chunk_id", F.posexplode_outer("embedding").alias("bucket", "w"))
    return long.filter("w <> 0").select("chunk_id", "bucket", F.round(F.col("w").cast("double"), 6).alias("weight"))


def _indexed(spark, sf) -> tuple[DataFrame, embedding.IdfModel]:
    """Chunks with sparse features, and the fitted weights; texts are cut and hashed once, and what that gives is stored."""
    place = scratch_dir(spark, "chunks")
    chunks(spark, sf).withColumn("counts", embedding.postings(F.col("text"))).write.parquet(place)
    cut = spark.read.parquet(place)
    model = embedding.fit_idf(cut, counts="counts")
    return embedding.hashed_features(cut, model, counts="counts").drop("counts"), model


def topk_by_text(spark, sf):
    cut = chunks(spark, sf)
    model = embedding.fit_idf(cut)
    stored = embedding.hashed_embedding(cut, model)
    return _rounded(retrieval.topk_by_text(stored, questions(spark, sf), model, carry=("file_path",)))


def inverted_topk(spark, sf):
    stored, model = _indexed(spark, sf)
    path = scratch_dir(spark, "postings")
    return _rounded(postings.inverted_topk(stored, questions(spark, sf), model, path, carry=("file_path",)))


# questions and answers


def context_assembly(spark, sf):
    stored, model = _indexed(spark, sf)
    found = answering.context_assembly(ask.retrieve(questions(spark, sf), stored, model))
    return found.select("query_id", "context", F.size("sources").alias("n_sources"))


def context_cut(spark, sf):
    """Contexts of eight chunks, more than the characters that fit."""
    stored, model = _indexed(spark, sf)
    found = answering.context_assembly(ask.retrieve(questions(spark, sf), stored, model, 8))
    return found.select("query_id", F.length("context").alias("n_chars"), F.sha2("context", 256).alias("context_hash"), F.size("sources").alias("n_sources"))


def distinct_sources(spark, sf):
    stored, model = _indexed(spark, sf)
    found = answering.distinct_sources(ask.retrieve(questions(spark, sf), stored, model))
    return found.select("query_id", answering.render_sources(F.col("sources")).alias("sources"))


def build_prompts(spark, sf):
    stored, model = _indexed(spark, sf)
    return ask.prompts(ask.contexts(questions(spark, sf), stored, model)).select("query_id", "prompt")


def rag_batch(spark, sf):
    stored, model = _indexed(spark, sf)
    answered = ask.rag_batch(questions(spark, sf), stored, model)
    return answered.select(
        "query_id", "status", "answer", "reply", F.array_join("sources", "|").alias("sources")
    )


def conversations(spark, sf) -> DataFrame:
    return table(spark, sf, "conversations")


def pairs(spark, sf) -> DataFrame:
    return sessions.pair_turns(conversations(spark, sf))


def pair_turns(spark, sf):
    return pairs(spark, sf)


def normalize_tokens(spark, sf):
    found = spread(documents(spark, sf)).select("file_path", tokens_of(F.col("text")).alias("tokens"))
    return found.select("file_path", F.size("tokens").alias("n"), F.array_join("tokens", " ").alias("tokens"))


def grounding_check(spark, sf):
    checked = answering.grounding_check(pairs(spark, sf), context="question")
    return checked.select("conv_id", "turn", "hits", "total", F.round("ratio", 6).alias("ratio"), "grounded")


def extractive_answer(spark, sf):
    made = answering.extractive_answer(pairs(spark, sf), context="answer")
    return made.select("conv_id", "turn", "answer", "no_answer")


def _json_text(col: str) -> Column:
    text = F.col(col)
    for char, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n")):
        text = F.replace(text, F.lit(char), F.lit(escaped))
    return text


def generated(spark, sf) -> DataFrame:
    """Generated texts of many kinds: plain, JSON, prose around JSON, broken, refused.

    Every text stands in one kind, chosen by its conversation and turn. Answers
    that hold no text, and single characters, are rows besides, numbered from 1000.
    """
    text = _json_text("text")
    kind = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(7))
    made = (
        F.when(kind == 0, F.col("text"))
        .when(kind == 1, F.concat(F.lit('{"answer": "'), text, F.lit('", "no_answer": false}')))
        .when(kind == 2, F.concat(F.lit('Here: {"answer": "'), text, F.lit('", "no_answer": "false"} done')))
        .when(kind == 3, F.concat(F.lit('{"answer": "'), text, F.lit('"}')))
        .when(kind == 4, F.concat(F.lit("[no_answer] "), F.col("text")))
        .when(kind == 5, F.concat(F.lit('{"answer": "'), text, F.lit('", "no_answer": 1.5} or {x}')))
        .otherwise(F.concat(F.lit('{"answer": "'), text, F.lit('", "no_answer": null}')))
    )
    said = spread(conversations(spark, sf))
    bare = (
        F.when(kind < 2, F.lit('{"answer": null, "no_answer": 0}'))
        .when(kind < 4, F.lit('{"answer": true, "no_answer": []}'))
        .otherwise(F.concat(F.lit(" "), F.substring("text", 1, 1)))
    )
    more = said.withColumn("generated", bare).withColumn("turn", F.col("turn") + 1000)
    return said.withColumn("generated", made).unionByName(more)


def parse_generated(spark, sf):
    return answering.post_process(generated(spark, sf)).select("conv_id", "turn", "answer", "no_answer")


def fragment_assembly(spark, sf):
    return answering.fragment_assembly(conversations(spark, sf), "conv_id", "turn", "text")


def resolve_answer(spark, sf):
    spoken = answering.fragment_assembly(
        conversations(spark, sf).filter("role = 'user'"), "conv_id", "turn", "text"
    ).withColumnRenamed("text", "context")
    asked = answering.post_process(generated(spark, sf)).join(spoken, "conv_id", "left")
    asked = asked.withColumn(
        "sources",
        F.when(F.col("role") == "system", F.array().cast("array<string>"))
        .otherwise(F.array(F.concat(F.lit("conv/"), "conv_id"))),
    ).withColumn("error", F.when(F.pmod(F.col("conv_id") + F.col("turn"), F.lit(11)) == 7, "timeout"))
    done = answering.resolve_answer(asked)
    return done.select("conv_id", "turn", "status", "answer", "reply", F.size("sources").alias("n_sources"))


def resolve_streamed(spark, sf):
    turns = conversations(spark, sf)
    said = turns.filter("role = 'assistant'").select(F.col("conv_id").alias("request_id"), "turn", "text")
    pieces = said.select("request_id", F.col("turn").alias("seq"), F.concat("text", F.lit(" ")).alias("piece"))
    about = turns.groupBy(F.col("conv_id").alias("request_id")).agg(
        F.max((F.col("role") == "system").cast("int")).alias("system")
    )
    # every third conversation is answered with the context of the next one
    shift = F.when(F.pmod("request_id", F.lit(3)) == 0, 1).otherwise(0)
    context = answering.fragment_assembly(
        turns.filter("role <> 'system'"), "conv_id", "turn", "text"
    ).select(F.col("conv_id").alias("_about"), F.col("text").alias("context"))
    asked = about.withColumn("_about", F.col("request_id") + shift).join(context, "_about", "left").select(
        "request_id", "context",
        F.when(F.col("system") == 1, F.array().cast("array<string>"))
        .otherwise(F.array(F.concat(F.lit("conv/"), "request_id"))).alias("sources"),
        F.when(F.pmod("request_id", F.lit(7)) == 5, "broken stream").alias("error"),
    )
    done = answering.resolve_streamed(pieces, asked)
    return done.select("request_id", "raw", "final", "status", F.size("sources").alias("n_sources"))


def question_intake(spark, sf):
    """Every text as a padded question, with blank lines and exits as rows between them."""
    turns = conversations(spark, sf)
    kind = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(9))
    said = turns.select("conv_id", (2 * F.col("turn")).alias("turn"), F.concat(F.lit(" \t"), "text", F.lit("\n ")).alias("text"))
    typed = F.when(kind == 0, " Quit ").when(kind == 1, "EXIT").otherwise(" \t ")
    more = turns.filter(kind < 4).select("conv_id", (2 * F.col("turn") + 1).alias("turn"), typed.alias("text"))
    return sessions.question_intake(said.unionByName(more), session="conv_id")


def render_history(spark, sf):
    return answering.render_history(pairs(spark, sf)).select("conv_id", "turn", "entry")


def history_sink(spark, sf):
    out = scratch_dir(spark, "history")
    history.write_history(pairs(spark, sf), out, F.date_add(F.to_date(F.lit(BEFORE)), F.col("turn").cast("int")))
    saved = history.read_history(spark, out)
    return saved.select(F.col("day").cast("string").alias("day"), "conv_id", "turn", "entry")


# ordered state


def events(spark, sf) -> DataFrame:
    return table(spark, sf, "events")


def _measured(state: DataFrame) -> DataFrame:
    return state.withColumn("ema", F.round("ema", 6))


def ema_latency(spark, sf):
    return _measured(adaptive.ema_latency(events(spark, sf), "user_id", ["ts", "event_id"], "value"))


def budget_controller(spark, sf):
    return _measured(
        adaptive.budget_controller(events(spark, sf), "user_id", ["ts", "event_id"], "value", LATENCY)
    )


def budget_controller_hot(spark, sf):
    """All events under one key; on every other day the latencies lie exactly on a bound."""
    day = F.pmod(F.dayofmonth("ts"), F.lit(4))
    target = LATENCY.latency_target
    value = F.when(day == 1, F.lit(target * adaptive.SLOW)).when(day == 3, F.lit(target * adaptive.FAST)).otherwise(F.col("value"))
    one = events(spark, sf).select(F.lit("all").alias("user"), "ts", "event_id", value.alias("value"))
    return _measured(adaptive.budget_controller(one, "user", ["ts", "event_id"], "value", LATENCY))


def budget_controller_stream(spark, sf):
    out = scratch_dir(spark, "budgets")
    schema = events(spark, sf).schema
    stream = (
        spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet")
        .option("maxFilesPerTrigger", 1).parquet(sf)
    )
    updates = budget_stream(stream, "user_id", ["ts", "event_id"], "value", LATENCY)

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/updates/batch={number}")

    run = (
        updates.writeStream.outputMode("update").foreachBatch(save)
        .option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    )
    run.awaitTermination()
    return _measured(latest_budgets(spark.read.parquet(f"{out}/updates"), "user_id"))


def _streamed(spark, sf) -> Collection:
    """A collection fed by a log of versions in two parts."""
    out = scratch_dir(spark, "versions")
    old = corpus(earlier(spark, sf), ".txt", BEFORE).withColumn("op", F.lit("upsert"))
    new = corpus(documents(spark, sf), ".txt", NOW).withColumn("op", F.lit("upsert"))
    gone = corpus(pages(spark, sf), ".txt", NOW).withColumn("op", F.lit("delete"))
    old.write.mode("append").parquet(f"{out}/log/1")
    new.unionByName(gone).write.mode("append").parquet(f"{out}/log/2")
    for part in ("1", "2"):
        log = spark.readStream.schema(old.schema).option("maxFilesPerTrigger", 1000).parquet(f"{out}/log/{part}")
        ingest_stream(spark, log, f"{out}/state", f"{out}/checkpoint-{part}").awaitTermination()
    return Collection(spark, f"{out}/state")


def streaming_ingest(spark, sf):
    return _streamed(spark, sf).chunks().select("chunk_id", "file_path", "chunk_no", "start", "text")


def streaming_vectors(spark, sf):
    """Vectors of the streamed collection: the same as after one run over all documents."""
    return _weights(_streamed(spark, sf))


# hooks


def _shape_encoder():
    return lambda texts: [[len(t), t.count(" "), t.count("\n")] for t in texts]


def encode_with(spark, sf):
    made = hooks.encode_with(chunks(spark, sf), _shape_encoder)
    parts = [F.get("embedding", i).cast("bigint").alias(n) for i, n in enumerate(("chars", "spaces", "breaks"))]
    return made.select("chunk_id", *parts)


#: What makes the generator and the extractor of the next two queries fail.
FAILS = "[fails] "


def _count_generator():
    def reply(prompt: str) -> str:
        if FAILS in prompt:
            raise ValueError("no reply")
        return '{"answer": "%d characters", "no_answer": false}' % len(prompt)

    return lambda prompts: [reply(p) for p in prompts]


def generate_with(spark, sf):
    marked = F.when(F.pmod(F.col("conv_id") + F.col("turn"), F.lit(5)) == 0, F.concat(F.lit(FAILS), "question"))
    asked = pairs(spark, sf).withColumn("question", F.coalesce(marked, "question"))
    asked = asked.withColumn("prompt", build_prompt(F.col("answer"), F.col("question")))
    made = hooks.generate_with(asked.drop("answer"), _count_generator)
    return answering.post_process(made).select("conv_id", "turn", "answer", "no_answer", "error")


def _plain_extractor():
    def parse(content: bytes) -> str:
        body = content[5:].decode("utf-8")
        if body.startswith(FAILS):
            raise ValueError("no pages")
        return body

    return parse


def extract_with(spark, sf):
    pdf = corpus(documents(spark, sf), ".pdf", NOW)
    number = F.substring_index(F.substring_index("file_path", "/", -1), ".", 1).cast("bigint")
    mark = F.when(number % 10 == 3, F.lit(FAILS.encode())).otherwise(F.lit(b""))
    pdf = pdf.withColumn("content", F.concat(F.lit(b"%PDF-"), mark, "content"))
    return files.load_documents(pdf, hooks.extract_with(_plain_extractor))


NAMES = (
    "content_hash", "snapshot_diff", "new_files", "modified_files", "deleted_files", "ingest_report",
    "manifest_upsert", "manifest_delete", "manifest_lookup", "manifest_source", "incremental_ingest", "collection_edits", "ingest_vectors", "chunk_text", "chunk_keys",
    "delete_chunks_by_file", "delete_chunks_by_id", "vector_append", "replace_chunks", "load_csv", "scan_corpus", "ensure_index",
    "markup_blocks", "markdown_html", "html_text", "load_documents", "quarantine", "embedding_dimension", "cosine_distance",
    "topk_by_vector", "topk_batch", "metadata_filter_topk", "approx_topk", "topk_blocks", "fit_idf", "hashed_embedding",
    "topk_by_text", "inverted_topk", "context_assembly", "context_cut", "distinct_sources",
    "extractive_answer", "grounding_check", "normalize_tokens", "parse_generated", "resolve_answer",
    "fragment_assembly", "resolve_streamed", "question_intake", "pair_turns", "render_history", "history_sink", "ema_latency",
    "budget_controller", "budget_controller_hot", "budget_controller_stream", "streaming_ingest", "streaming_vectors", "encode_with", "generate_with",
    "extract_with", "rag_batch",
)

QUERIES = {name: globals()[name] for name in NAMES} | {"build_prompt": build_prompts}
