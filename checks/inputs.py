"""The given tables in the shapes that the operators read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echolane.functions.scalars import day_of
from echolane.operators import corpus as C
from echolane.operators import searchlog as L
from echolane.session import materialise
from echolane.sources.tables import read_table, spread

# The synthetic texts hold no apostrophe, emoji or noise marker, so each document gets two
# more lines that do: one to be dropped and one to be cleaned.
NOISE_LINE = "ID="
EXTRA_LINE = " 😘😘 it's '' so ' "
EXTRA_REST = "!!! love ❤️ 1234567890123 very👍🏽nice　a。b"

KINDS = {1: "songs", 2: "albums", 3: "singers", 4: "playlist", 5: "song", 6: "singer", 7: "playlists"}


def corpus_lines(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, line_no, line`` of all documents."""
    docs = spread(read_table(spark, folder, "documents").select("doc_id", "text", "lang", "source"), "doc_id")
    text = F.concat(
        "text",
        F.lit("\n" + NOISE_LINE),
        F.col("doc_id").cast("string"),
        F.lit(" "),
        "source",
        F.lit("\n"),
        "lang",
        F.lit(EXTRA_LINE),
        "source",
        F.lit(EXTRA_REST),
    )
    return C.split_lines(docs.withColumn("text", text), "doc_id", "text")


def marked_lines(spark: SparkSession, folder: str) -> DataFrame:
    """``kind, id, line_no, line`` of all documents and, for their markup, of all pages."""
    docs = corpus_lines(spark, folder).select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "line_no", "line")
    pages = page_lines(spark, folder).select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), "line_no", "line")
    return docs.unionByName(pages)


def page_lines(spark: SparkSession, folder: str) -> DataFrame:
    pages = spread(read_table(spark, folder, "pages").select("page_id", "html"), "page_id")
    return C.split_lines(pages, "page_id", "html")


def chat_lines(spark: SparkSession, folder: str) -> DataFrame:
    turns = spread(read_table(spark, folder, "conversations"), "conv_id", "turn")
    return turns.select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def sequences(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Encoded, cut and padded document sentences and their vocabulary."""
    sentences, vocab = _sentences(spark, folder)
    return C.encode_sequences(sentences, ["doc_id", "line_no"], vocab), vocab


def whole_sentences(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Encoded document sentences in full length, with the end mark, and their vocabulary."""
    sentences, vocab = _sentences(spark, folder)
    return materialise(C.whole_sentences(sentences, ["doc_id", "line_no"], vocab), "sentences"), vocab


def _sentences(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Document sentences, cleaned once, and the vocabulary of all of them."""
    sentences = materialise(C.tokenize(corpus_lines(spark, folder)), "tokens")
    return sentences, C.build_vocab(C.word_freq(sentences), 1, (C.T.END_MARK,))


def users(spark: SparkSession, folder: str) -> DataFrame:
    """People with a country; a negative balance marks a robot id."""
    robot = F.when(F.col("c_acctbal") < 0, F.lit(5 << 48)).otherwise(F.lit(0).cast("long"))
    return read_table(spark, folder, "customer").select(
        (F.col("c_custkey") + robot).alias("user_id"), F.col("c_nationkey").alias("country_code")
    )


def openers(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("user_id"),
        F.col("o_orderkey").alias("recording_id"),
        F.col("o_orderpriority").alias("comment"),
    )


def replied(spark: SparkSession, folder: str) -> DataFrame:
    lines = read_table(spark, folder, "lineitem").where("l_returnflag = 'R'")
    return lines.select(F.col("l_orderkey").alias("id")).distinct()


def recordings(spark: SparkSession, folder: str) -> DataFrame:
    """Recordings with an owner; suppliers in debt have none."""
    owner = F.when(F.col("s_acctbal") >= 0, F.col("s_nationkey").cast("long"))
    suppliers = read_table(spark, folder, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), owner.alias("user_id"))
    lines = read_table(spark, folder, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber")
    return lines.join(suppliers, "l_suppkey").select(
        F.col("l_orderkey").alias("id"), "user_id", F.col("l_linenumber").alias("media_type")
    )


def chat_comments(spark: SparkSession, folder: str) -> DataFrame:
    """Turns as comments: the first of a conversation is on top, later ones reply to it."""
    first = F.col("turn") == 0
    return read_table(spark, folder, "conversations").select(
        F.when(first, F.col("conv_id") + 1).otherwise(-F.col("conv_id") * 1000 - F.col("turn")).alias("id"),
        F.when(first, F.lit(0).cast("long")).otherwise(F.col("conv_id") + 1).alias("parent_id"),
        F.col("role"),
        F.col("text").alias("comment"),
    )


def day_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events with a day, a type and five ids, each of which is missing for some users."""
    user, kind = F.col("user_id"), F.col("event_type")
    rows = read_table(spark, folder, "events")
    return rows.select(
        "event_id",
        F.when(F.col("value") < 1, F.lit(None).cast("long")).otherwise(user).alias("user_id"),
        F.when(kind != "error", user).alias("song_id"),
        F.when(kind != "view", user + 1).alias("album_id"),
        F.when(kind != "signup", user + 2).alias("playlist_id"),
        F.when(kind == "purchase", user + 3).alias("singer_id"),
        kind.alias("type"),
        F.col("ts").alias("timestamp"),
        "value",
        day_of(F.col("ts")).alias("dt"),
    )


def search_events(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines as search events; the keyword is the first word of the part's name."""
    lines = read_table(spark, folder, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_shipdate"
    )
    lines = spread(lines, "l_orderkey", "l_partkey")
    orders = read_table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    parts = read_table(spark, folder, "part").select("p_partkey", "p_name")
    rows = lines.join(orders, lines.l_orderkey == orders.o_orderkey).join(parts, lines.l_partkey == parts.p_partkey)
    flag = F.col("l_returnflag")
    kind = F.element_at(F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair]), F.col("l_linenumber"))
    return rows.select(
        F.col("o_custkey").alias("user"),
        F.col("l_partkey").alias("song"),
        F.col("l_linenumber").cast("long").alias("album"),
        F.col("l_orderkey").alias("playlist"),
        F.col("l_suppkey").alias("singer"),
        F.when(flag == "R", "click").when(flag == "A", "show").otherwise("other").alias("action"),
        F.substring_index("p_name", " ", 1).alias("keyword"),
        kind.alias("type"),
        day_of(F.col("o_orderdate")).alias("timestamp"),
        day_of(F.when(flag == "N", F.col("o_orderdate")).otherwise(F.col("l_shipdate"))).alias("dt"),
        F.col("l_orderkey").alias("order"),
        F.col("l_linenumber").alias("position"),
        (flag == "R").cast("int").alias("label"),
    )


def catalog(spark: SparkSession, folder: str) -> DataFrame:
    """Every part as a song, album, playlist and singer: ``id, type, name``."""
    kinds = F.explode(F.array(*map(F.lit, ("song", "album", "playlist", "singer"))))
    parts = spread(read_table(spark, folder, "part").select("p_partkey", "p_name", "p_type"), "p_partkey")
    return parts.select(F.col("p_partkey").alias("id"), kinds.alias("type"), F.concat_ws(" ", "p_name", "p_type").alias("name"))


def search_results(spark: SparkSession, folder: str) -> DataFrame:
    words = F.substring_index("p_name", " ", 1).alias("keyword")
    kinds = F.explode(F.array(*map(F.lit, ("song", "album", "playlist", "singer"))))
    asked = read_table(spark, folder, "part").select(words).distinct().select("keyword", kinds.alias("type"))
    return L.result_lists(L.keyword_search(asked, catalog(spark, folder)))


def daily_stats(spark: SparkSession, folder: str, key: str, name: str) -> DataFrame:
    """Five counters per entity and day."""
    lines = read_table(spark, folder, "lineitem")
    return lines.groupBy(F.col(key).cast("long").alias(name), day_of(F.col("l_shipdate")).alias("dt")).agg(
        F.count(F.lit(1)).alias("play_num"),
        F.count_if(F.col("l_returnflag") == "R").alias("like_num"),
        F.sum(F.col("l_quantity").cast("long")).alias("download_num"),
        F.sum("l_linenumber").alias("share_num"),
        F.count_if(F.col("l_linestatus") == "O").alias("comment_num"),
    )


def song_names(spark: SparkSession, folder: str) -> DataFrame:
    """Names of songs: ``song, name, album_name, singer_name``. Parts above size 40 have none, to have missing names."""
    return read_table(spark, folder, "part").where("p_size <= 40").select(
        F.col("p_partkey").alias("song"),
        F.col("p_name").alias("name"),
        F.col("p_brand").alias("album_name"),
        F.col("p_type").alias("singer_name"),
    )


def impressions(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines as shown items, with the columns that tell rows apart."""
    lines = read_table(spark, folder, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_returnflag", "l_shipdate"
    )
    orders = read_table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    rows = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    return rows.select(
        F.col("o_custkey").cast("string").alias("uid"),
        (F.col("l_partkey") + 1).alias("iid"),
        (F.col("l_returnflag") == "R").cast("int").alias("click"),
        F.col("l_orderkey").alias("order_no"),
        F.col("l_linenumber").alias("line_no"),
        F.col("l_suppkey").alias("shop"),
        day_of(F.col("l_shipdate")).alias("day"),
    )


ROW_KEY = ["order_no", "line_no", "iid", "shop", "day"]


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors, of another length in each class: ``id, vec, label``."""
    rows = read_table(spark, folder, "embeddings")
    scale = (1 + F.col("label")).cast("double")
    vec = F.transform(F.col("embedding").cast("array<double>"), lambda x: x * scale)
    return rows.select(F.col("vec_id").alias("id"), vec.alias("vec"), "label")


def scored_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines whose shop and part have a vector: ``user, item, click, score``."""
    from echolane.operators.similarity import score_pairs

    lines = read_table(spark, folder, "lineitem")
    pairs = lines.select(
        F.col("l_suppkey").alias("user"),
        F.col("l_partkey").alias("item"),
        (F.col("l_returnflag") == "R").cast("int").alias("click"),
    )
    known = vectors(spark, folder).select("id", "vec")
    return score_pairs(pairs, known, known).withColumn("score", F.round("score", 6))
