"""BM25 keyword search over an inverted index, for many queries at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekiln.functions.tokens import query_phrases, tokens
from lorekiln.session import HOT_BROADCAST_ROWS, durable

K1, B = 1.2, 0.75
#: Hits that a keyword search returns at most, whatever is asked for.
POOL = 30


def tokenised(docs: DataFrame, id_column: str, columns: list[str]) -> DataFrame:
    """(id, col, tokens): one row for each indexed text column of each document."""
    parts = F.array(*[F.struct(F.lit(i).alias("col"), tokens(F.col(c)).alias("tokens")) for i, c in enumerate(columns)])
    return docs.select(F.col(id_column).alias("id"), F.explode(parts).alias("p")).select("id", "p.col", "p.tokens")


def postings(docs: DataFrame, id_column: str, columns: list[str]) -> DataFrame:
    """(term, id, col, tf, positions): the inverted index.

    The texts are spread by id, so that the terms of a document are counted where it lies and no token is shuffled.
    """
    spread = docs.select(F.col(id_column).alias("id"), *columns).repartition("id")
    rows = tokenised(spread, "id", columns).select("id", "col", F.posexplode("tokens").alias("position", "term"))
    return rows.groupBy("term", "id", "col").agg(F.count(F.lit(1)).alias("tf"), F.sort_array(F.collect_list("position")).alias("positions"))


def doc_lengths(docs: DataFrame, id_column: str, columns: list[str]) -> DataFrame:
    """(id, dl): tokens of a document in all its columns; documents without tokens count."""
    total = sum((F.size(tokens(F.col(c))) for c in columns), F.lit(0))
    return docs.select(F.col(id_column).alias("id"), total.cast("bigint").alias("dl"))


def corpus_stats(docs: DataFrame, id_column: str, columns: list[str]) -> DataFrame:
    """(n, total_len, avgdl): one row."""
    lengths = doc_lengths(docs, id_column, columns)
    return lengths.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total_len"), F.avg("dl").alias("avgdl"))


def idf(n: Column, df: Column) -> Column:
    """Inverse document frequency with the index's floor."""
    raw = F.log((n - df + 0.5) / (df + 0.5))
    return F.when(raw > 0, raw).otherwise(F.lit(1e-6))


def term_stats(docs: DataFrame, id_column: str, columns: list[str]) -> DataFrame:
    """(term, df, idf) of every term of the index."""
    rows = tokenised(docs, id_column, columns).select("id", F.explode(F.array_distinct("tokens")).alias("term")).distinct()
    counts = rows.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n = corpus_stats(docs, id_column, columns).select("n")
    return counts.join(F.broadcast(n)).select("term", "df", idf(F.col("n"), F.col("df")).alias("idf"))


def phrases(queries: DataFrame, query_id: str, text: str) -> DataFrame:
    """(query_id, phrase, words, times): the token sequences of each query; a repeated term counts again."""
    rows = queries.select(F.col(query_id).alias("query_id"), F.explode(query_phrases(F.col(text))).alias("term"))
    rows = rows.select("query_id", tokens(F.col("term")).alias("t")).filter(F.size("t") > 0)
    return rows.groupBy("query_id", F.array_join("t", " ").alias("phrase"), F.size("t").alias("words")).agg(F.count(F.lit(1)).alias("times"))


def _sequences(words: Column, m: int) -> Column:
    """All runs of ``m`` neighbouring tokens, joined by a blank."""
    starts = F.when(F.size(words) >= m, F.sequence(F.lit(1), F.size(words) - (m - 1))).otherwise(F.array().cast("array<int>"))
    return words if m == 1 else F.transform(starts, lambda i: F.array_join(F.slice(words, i, m), " "))


def phrase_hits(docs: DataFrame, id_column: str, columns: list[str], wanted: DataFrame) -> DataFrame:
    """(id, phrase, f, dl): occurrences of each wanted phrase, all columns together, none across columns, and the
    document's tokens; and for each document one row of the empty phrase, so that one scan serves the corpus too.

    Documents give their word sequences of the lengths that occur among the phrases; only those that are asked for
    survive the join, before anything is shuffled if the phrases are few enough to broadcast.
    """
    distinct = wanted.select("phrase", "words").distinct()
    lengths = sorted(r[0] for r in distinct.select("words").distinct().collect())
    few = distinct.limit(HOT_BROADCAST_ROWS + 1).count() <= HOT_BROADCAST_ROWS
    split = F.array(*[tokens(F.col(c)) for c in columns])
    # the generator keeps the tokens from being made again for each use
    rows = docs.select(F.col(id_column).alias("id"), F.explode(F.array(split)).alias("split"))
    total = sum((F.size(F.col("split")[i]) for i in range(len(columns))), F.lit(0)).cast("bigint")
    parts = [_sequences(F.col("split")[i], m) for i in range(len(columns)) for m in lengths]
    every = F.flatten(F.array(F.array(F.lit("")), *parts))
    keys = distinct.select("phrase").unionByName(docs.sparkSession.createDataFrame([("",)], "phrase string"))
    found = rows.select("id", total.alias("dl"), F.explode(every).alias("phrase")).join(F.broadcast(keys) if few else keys, "phrase")
    return found.groupBy("id", "phrase").agg(F.count(F.lit(1)).alias("f"), F.first("dl").alias("dl"))


def index_hits(index: DataFrame, lengths: DataFrame, wanted: DataFrame) -> DataFrame:
    """``phrase_hits`` from the inverted index (``postings``, ``doc_lengths``): no text is read.

    The terms of the phrases are broadcast and select the postings. For phrases of several terms the postings of these
    go to their document, each once whatever the number of phrases; where terms stand in a row there, the run is looked
    up among the phrases.
    """
    distinct = wanted.select("phrase", "words").distinct()
    counts = [r[0] for r in distinct.groupBy("words").count().orderBy("words").collect()]
    few = distinct.limit(HOT_BROADCAST_ROWS + 1).count() <= HOT_BROADCAST_ROWS
    small = F.broadcast if few else lambda rows: rows
    found = index.join(small(distinct.filter("words = 1").select(F.col("phrase").alias("term"))), "term").select("id", F.col("term").alias("phrase"), "tf")
    lengthy = [m for m in counts if m > 1]
    if lengthy:
        longer = distinct.filter("words > 1").select("phrase")
        terms = longer.select(F.explode(F.split("phrase", " ")).alias("term")).distinct()
        places = index.join(small(terms), "term").select("id", "col", F.transform("positions", lambda p: F.struct(p.alias("at"), F.col("term").alias("term"))).alias("p"))
        texts = places.groupBy("id", "col").agg(F.sort_array(F.flatten(F.collect_list("p"))).alias("p"))
        runs = texts.select("id", F.explode(F.flatten(F.array(*[_runs(F.col("p"), m) for m in lengthy]))).alias("phrase"))
        found = found.unionByName(runs.join(small(longer), "phrase").select("id", "phrase", F.lit(1).cast("bigint").alias("tf")))
    found = found.groupBy("id", "phrase").agg(F.sum("tf").alias("f"))
    return found.join(lengths.select("id", "dl"), "id")


def _runs(places: Column, m: int) -> Column:
    """The terms, joined by a blank, of ``m`` of the sorted (at, term) that stand at neighbouring positions."""
    starts = F.when(F.size(places) >= m, F.sequence(F.lit(1), F.size(places) - (m - 1))).otherwise(F.array().cast("array<int>"))
    whole = F.filter(starts, lambda i: F.element_at(places, i + (m - 1))["at"] - F.element_at(places, i)["at"] == m - 1)
    return F.transform(whole, lambda i: F.array_join(F.slice(places, i, m)["term"], " "))


def _classes(wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(query_id, class) of each query with a phrase, and (class, phrase, words, times): queries that ask for the same
    phrases equally often are one class, which is searched once."""
    bag = F.sort_array(F.collect_list(F.struct("phrase", "words", "times"))).alias("bag")
    named = wanted.groupBy("query_id").agg(bag)
    named = durable(named.withColumn("class", F.sha2(F.to_json(F.struct("bag")), 256)))
    return named.select("query_id", "class"), named.dropDuplicates(["class"]).select("class", F.inline("bag"))


def _best(hits: DataFrame, stats: DataFrame, asked: DataFrame, order: DataFrame, k: int) -> DataFrame:
    """(class, id, score, rank): the best ``k`` documents of each class; lower scores are better, ties in arrival order.

    Exact, without the score of every document that holds a phrase of a class. Of those that hold one phrase only, the
    best k of this phrase can be among the best k of the class, as every part of a score lowers it; they are the same for
    all classes that ask for it equally often. Those that hold more are scored in full where their hits lie.
    """
    few = asked.limit(HOT_BROADCAST_ROWS + 1).count() <= HOT_BROADCAST_ROWS
    small = F.broadcast if few else lambda rows: rows
    df = hits.groupBy("phrase").agg(F.count(F.lit(1)).alias("df"))
    # a repeated id has a place for each of its rows
    ties = order.groupBy("id").agg(F.slice(F.sort_array(F.collect_list(F.struct("tie"))), 1, k).alias("ties"))
    f = F.col("f")
    part = idf(F.col("n"), F.col("df")) * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    parts = hits.join(small(df), "phrase").join(F.broadcast(stats.select("n", "avgdl"))).select("id", "phrase", part.alias("part")).join(ties, "id")

    own = -(F.col("part") * F.col("times"))
    place = F.row_number().over(Window.partitionBy("phrase", "times").orderBy(F.round(own, 9), F.col("ties")[0]))
    alone = parts.join(small(asked.select("phrase", "times").distinct()), "phrase").withColumn("r", place).filter(F.col("r") <= k)
    alone = alone.join(small(asked), ["phrase", "times"]).select("class", "id", own.alias("score"), "ties")

    # both counts and the sum are taken inside the partitions by id, and only what counts twice leaves them
    several = parts.withColumn("held", F.count(F.lit(1)).over(Window.partitionBy("id"))).filter("held > 1")
    long = asked.withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("class"))).filter("size > 1")
    joint = several.join(small(long), "phrase").groupBy("id", "class").agg((-F.sum(F.col("part") * F.col("times"))).alias("score"), F.count(F.lit(1)).alias("met"), F.first("ties").alias("ties"))
    joint = joint.filter("met > 1").select("class", "id", "score", "ties")

    # of a document's part and its full score the full one is lower
    scored = alone.unionByName(joint).groupBy("class", "id").agg(F.min("score").alias("score"), F.first("ties").alias("ties"))
    rank = F.row_number().over(Window.partitionBy("class").orderBy(F.round("score", 9), "place"))
    return scored.select("class", "id", "score", F.explode("ties").alias("place")).withColumn("rank", rank).filter(F.col("rank") <= k).select("class", "id", "score", "rank")


def keyword_search(docs: DataFrame, queries: DataFrame, id_column: str, columns: list[str], query_id: str, text: str, order: str, k: int = 8) -> DataFrame:
    """(query_id, id, score, rank): the best ``k`` documents of each query, at most 30; ties in arrival order.

    Null texts have no tokens but count as documents. A query without terms has no rows.
    """
    members, asked = _classes(phrases(queries, query_id, text))
    hits = durable(phrase_hits(docs, id_column, columns, asked))
    # a repeated id counts as often as it stands there
    stats = hits.filter("phrase = ''").agg(F.sum("f").alias("n"), (F.sum(F.col("f") * F.col("dl")) / F.sum("f")).alias("avgdl"))
    places = docs.select(F.col(id_column).alias("id"), F.col(order).alias("tie"))
    return _told(_best(hits.filter("phrase != ''"), stats, asked, places, min(k, POOL)), members)


def index_search(index: DataFrame, lengths: DataFrame, queries: DataFrame, query_id: str, text: str, order: DataFrame, k: int = 8) -> DataFrame:
    """``keyword_search`` on a stored inverted index: ``postings``, ``doc_lengths`` and (id, tie), the arrival order."""
    members, asked = _classes(phrases(queries, query_id, text))
    stats = lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    return _told(_best(durable(index_hits(index, lengths, asked)), stats, asked, order, min(k, POOL)), members)


def _told(best: DataFrame, members: DataFrame) -> DataFrame:
    return best.join(members, "class").select("query_id", "id", "score", "rank")
