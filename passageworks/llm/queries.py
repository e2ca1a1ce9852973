"""The registered queries of the operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.binding import bind
from ..session import scratch_dir
from . import chat, exact_topk, fingerprints, hard_negatives, line_dedup, mixing, ngram_join, pages, pieces, quality, secrets, token_files, whitening
from .common import store, table
from .oracle import ORACLE  # noqa: F401

#: The folder of the public tokenizer files; a parameter of every query that reads one.
TOKENIZERS = "/opt/tokenizers"


def chat_records(spark: SparkSession, sf: str) -> DataFrame:
    """``(conv_id, record)``: every conversation as JSON, in a layout chosen by its id and shape.

    The rows of one conversation meet in one row, which the contract's digests ask for.
    """
    extra = spark.createDataFrame([(-7, t, r, "</s>[INST] ok [/INST]") for t, r in enumerate(("user", "assistant"))], "conv_id LONG, turn LONG, role STRING, text STRING")
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    said = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(said)).alias("t"))
    roles = F.array_join(F.transform("t", lambda x: x["role"]), ",")
    usual = F.forall("t", lambda x: x["role"].isin("system", "user", "assistant"))
    way = F.pmod("conv_id", F.lit(4))

    def listed(outer: str, role: str, text: str, names: dict[str, str] | None = None) -> Column:
        def item(x: Column) -> Column:
            r = x["role"]
            for name, as_ in (names or {}).items():
                r = F.when(x["role"] == name, F.lit(as_)).otherwise(r)
            return F.struct(r.alias(role), x["text"].alias(text))

        return F.to_json(F.struct(F.transform("t", item).alias(outer)))

    texts = lambda *names: F.to_json(F.struct(*(F.get("t", i)["text"].alias(n) for i, n in enumerate(names))))
    nested = F.transform("t", lambda x: F.struct(F.struct(x["role"].alias("role")).alias("author"), F.struct(x["text"].alias("text")).alias("content")))
    spoken = F.transform("t", lambda x: F.struct(x["role"].alias("speaker"), x["text"].alias("utterance")))
    record = (
        F.when((way == 0) & (roles == "user,assistant"), texts("prompt", "response"))
        .when((way == 1) & (roles == "user,assistant"), texts("instruction", "output"))
        .when((way < 2) & (roles == "system,user,assistant"), texts("system", "instruction", "output"))
        .when((way == 1) & usual, listed("conversations", "from", "value", {"user": "human", "assistant": "gpt"}))
        .when(way == 2, F.to_json(F.struct(nested.alias("messages"))))
        .when((way == 3) & usual, F.to_json(F.struct(F.struct(spoken.alias("turns")).alias("dialog"))))
        .otherwise(listed("messages", "role", "content"))
    )
    return turns.select("conv_id", record.alias("record"))


def op1_chat_format(spark: SparkSession, sf: str) -> DataFrame:
    """Format every conversation and read digests back from the formatted text."""
    done = chat.format_chats(chat_records(spark, sf)).select("conv_id", "layout", "formatted", "loss")
    turns = bind(chat.read_turns(F.col("formatted")), lambda t: F.struct(
        F.size(t).cast("long").alias("n"),
        F.sha2(F.array_join(F.transform(t, lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), ""), 256).alias("sha"),
    ))
    loss = bind(F.array_join(chat.read_loss(F.col("formatted"), F.col("loss")), ""), lambda x: F.struct(F.length(x).cast("long").alias("n"), F.sha2(x, 256).alias("sha")))
    read = done.select("conv_id", "layout", F.length("formatted").cast("long").alias("formatted_chars"), turns.alias("turns"), loss.alias("loss"))
    return read.select(
        "conv_id", F.col("turns.n").alias("n_turns"), F.col("turns.sha").alias("turns_sha256"), F.col("loss.n").alias("loss_chars"), F.col("loss.sha").alias("loss_sha256"), "formatted_chars", "layout"
    )


def op2_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Secrets of every document; of the base ones, how many belong to few owners and how many are shared."""
    found = secrets.find_secrets(table(spark, sf, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    number = lambda keep, name: F.size(F.filter("base", keep)).cast("long").alias(name)
    return found.select(
        F.col("id").alias("doc_id"), count("assign"), count("access"), count("hex"),
        F.sha2(secrets.joined(F.col("base")), 256).alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"),
        number(lambda s: s["live"], "n_live"), number(lambda s: ~s["live"], "n_shared"),
    )


def op5_html_extraction(spark: SparkSession, sf: str) -> DataFrame:
    """Main text of every page."""
    text = pages.extract_text(table(spark, sf, "pages").select("page_id", "url", "html"))
    return text.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op6_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Counts and verdict of every document; the counts are taken once and stored."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", "text")
    measured = store(quality.measure(docs).drop("text"), "quality")
    judged = quality.apply_cutoffs(measured, quality.certified_cutoffs(measured, table(spark, sf, "labels")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def following(ids: DataFrame) -> DataFrame:
    """``ids`` with ``next_id``, the next larger id, for distinct ids; the first one follows the last.

    Ids are dealt by range; inside a range the next one is a neighbour, and the
    last one of a range is followed by the first of the next range that has any.
    Only one row per range meets in one task. Ranges are drawn from a sample, so
    they are stored: both uses of them must see the same ones.
    """
    dealt = store(ids.repartitionByRange("doc_id").withColumn("part", F.spark_partition_id()), "ranges")
    inside = dealt.withColumn("next_id", F.lead("doc_id").over(Window.partitionBy("part").orderBy("doc_id")))
    inside = inside.withColumn("last", F.row_number().over(Window.partitionBy("part").orderBy(F.desc_nulls_last("doc_id"))) == 1)
    parts = dealt.groupBy("part").agg(F.min(F.struct("doc_id")).alias("first"))
    order = Window.orderBy("part")
    firsts = parts.select("part", F.coalesce(F.lead("first").over(order), F.min("first").over(Window.partitionBy())).alias("after"))
    joined = inside.join(firsts, "part")
    return joined.withColumn("next_id", F.when(F.col("last"), F.col("after.doc_id")).otherwise(F.col("next_id"))).drop("part", "last", "after")


def op8_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    """Fingerprints of every document and its edited text.

    Documents of one id have one next document: of the rows of the next larger id
    the one whose text has the least hash. A null id counts as the least one.
    """
    docs = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("n_chars", F.length("text").cast("long")).withColumn("text_hash", F.xxhash64("text"))
    own = docs.withColumn("parts", fingerprints.fingerprint(F.col("text")))
    ids = docs.groupBy("doc_id").agg(F.min("text_hash").alias("text_hash"), F.max("n_chars").alias("n_chars"))
    links = store(following(ids), "links")
    chosen = links.select(F.col("doc_id").alias("next_id"), F.col("text_hash").alias("next_hash"))
    links = links.select(F.col("doc_id").alias("prev_id"), "next_id", F.floor(F.col("n_chars") / 4).cast("int").alias("need"))
    links = links.join(chosen.withColumnRenamed("next_id", "id"), F.col("id").eqNullSafe(F.col("next_id")), "left").drop("id")
    # both joins deal the texts by the id alone and read the same columns, so they share one shuffle
    same = F.col("text_hash").bitwiseXOR(F.col("next_hash")) == 0
    nexts = own.join(links, F.col("doc_id").eqNullSafe(F.col("next_id")) & same).select(
        "prev_id", F.substr("text", F.lit(1), F.least("need", F.col("n_chars").cast("int"))).alias("start"), F.col("parts").alias("next_parts")
    )
    nexts = nexts.dropDuplicates(["prev_id"])
    rows = own.join(nexts, F.col("doc_id").eqNullSafe(F.col("prev_id")), "left")
    cut = F.floor(F.col("n_chars") / 4).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), (F.col("n_chars") - cut).cast("int")), F.substr("start", F.lit(1), cut))
    changed = bind(edited, lambda t: F.struct(F.sha2(t, 256).alias("sha"), fingerprints.fingerprint(t).alias("parts")))
    rows = rows.select("doc_id", "n_chars", "text_hash", "parts", "next_parts", changed.alias("edited"))
    return rows.select(
        "doc_id", "n_chars", F.col("edited.sha").alias("edited_sha256"), fingerprints.packed(F.col("parts")).alias("fingerprint"),
        fingerprints.packed(F.col("edited.parts")).alias("edited_fingerprint"),
        fingerprints.likeness(F.col("parts"), F.col("edited.parts")).alias("near_edited"),
        fingerprints.likeness(F.col("parts"), F.col("next_parts")).alias("near_next"), "text_hash",
    )


def op10_token_files(spark: SparkSession, sf: str) -> DataFrame:
    """Write all documents' token ids to files and read their places and checksums back."""
    path = scratch_dir(spark, "token-files")
    token_files.write_ids(table(spark, sf, "documents"), path, f"{TOKENIZERS}/word_bpe_49k.json", end_id=2)
    read = token_files.read_ids(spark, path)
    return read.select(F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32", "shard", "segment")


def op3_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Every document without the lines that an earlier place has, or nearly has."""
    done = line_dedup.dedup_lines(table(spark, sf, "documents").select("doc_id", "text"))
    return done.select("doc_id", "text", F.length("text").cast("long").alias("n_chars"), F.col("_line_all").alias("n_lines"), F.col("_line_gone").alias("n_dropped"))


def op4_ngram_join(spark: SparkSession, sf: str) -> DataFrame:
    """The component of every document under links of similar texts."""
    joined = ngram_join.join_similar(table(spark, sf, "documents"))
    return joined.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


#: Shares of tokens that the mixture aims at, by domain.
TARGETS = {"clean": 0.95, "toxic": 0.02, "junk": 0.03}


def op7_source_mixing(spark: SparkSession, sf: str) -> DataFrame:
    """Posterior, rate and number of copies of every document."""
    weights = [TARGETS[d] for d in mixing.DOMAINS]
    rated = mixing.rated(table(spark, sf, "documents"), table(spark, sf, "labels"), mixing.domain_of(), weights)
    chances = (F.round(F.get("_mix_p", i), 9).alias(f"p_{d}") for i, d in enumerate(mixing.DOMAINS))
    return rated.select(F.col("_mix_id").alias("doc_id"), F.col("_mix_tokens").alias("n_tokens"), *chances, F.round("_mix_rate", 9).alias("rate"), F.col("_mix_copies").alias("copies"))


def op9_sentencepiece(spark: SparkSession, sf: str) -> DataFrame:
    """Ids and sampled segmentations of every document, with digests of its text and of what they decode to.

    The text's digest stands beside those of the decoded ids and of each decoded sample.
    """
    rows = pieces.encode(table(spark, sf, "documents"), f"{TOKENIZERS}/piece_bpe_32k.model", digests=True)
    return rows.select(F.col("id").alias("doc_id"), "n_pieces", "ids", "samples", "text_sha256", "decoded_sha256", "samples_sha256")


def encoded(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_pieces, ids, samples)`` of every row."""
    rows = pieces.encode(docs, f"{TOKENIZERS}/piece_bpe_32k.model")
    return rows.select(F.col("id").alias("doc_id"), "n_pieces", "ids", "samples")


def op11_exact_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The ten best rows for every hundredth vector."""
    return exact_topk.exact_topk(table(spark, sf, "embeddings"), F.col("vec_id") % 100 == 0)


def op12_whitening(spark: SparkSession, sf: str) -> DataFrame:
    """Sixteen whitened components of every vector."""
    done = whitening.whiten(table(spark, sf, "embeddings"))
    return done.withColumn("deviation", F.col("deviation").cast("long"))


def op13_hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    """Hard negatives of every fiftieth vector; every seventh row's label is wrong by one."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine_negatives(table(spark, sf, "embeddings"), F.col("vec_id") % 50 == 0, label)


QUERIES = {
    "op1_chat_format": op1_chat_format,
    "op2_secret_scan": op2_secret_scan,
    "op3_line_dedup": op3_line_dedup,
    "op4_ngram_join": op4_ngram_join,
    "op5_html_extraction": op5_html_extraction,
    "op6_quality_rules": op6_quality_rules,
    "op7_source_mixing": op7_source_mixing,
    "op8_fingerprints": op8_fingerprints,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_token_files": op10_token_files,
    "op11_exact_topk": op11_exact_topk,
    "op12_whitening": op12_whitening,
    "op13_hard_negatives": op13_hard_negatives,
}
