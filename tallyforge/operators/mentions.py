"""Mentions of the aliases of a table, of any size, in texts: word n-grams joined by hash.

A text gives its runs of one word, two words and so on, as many as aliases have; equality with
an alias is a join. Where mentions overlap the longest counts, of equal ones the first.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_WORD = re.compile(r"\w+")
#: Aliases that go to every task; of a larger table the runs of words are joined as they are.
FEW = 20_000
#: The names of image categories and the words for them.
CATEGORY_ALIASES = {
    "person": ("person", "people", "man", "men", "woman", "women", "boy", "boys", "girl", "girls", "child", "children", "lady", "guy", "player", "rider", "skier", "surfer", "batter", "catcher"),
    "bicycle": ("bicycle", "bicycles", "bike", "bikes"),
    "car": ("car", "cars", "automobile", "vehicle"),
    "motorcycle": ("motorcycle", "motorcycles", "motorbike", "motorbikes"),
    "airplane": ("airplane", "airplanes", "plane", "planes", "aircraft"),
    "bus": ("bus", "buses"),
    "train": ("train", "trains", "locomotive"),
    "truck": ("truck", "trucks"),
    "boat": ("boat", "boats", "ship", "ships"),
    "traffic light": ("traffic light", "traffic lights", "stoplight"),
    "fire hydrant": ("fire hydrant", "fire hydrants", "hydrant"),
    "stop sign": ("stop sign", "stop signs"),
    "parking meter": ("parking meter", "parking meters", "meter"),
    "bench": ("bench", "benches"),
    "bird": ("bird", "birds"),
    "cat": ("cat", "cats", "kitten"),
    "dog": ("dog", "dogs", "puppy"),
    "horse": ("horse", "horses", "pony"),
    "sheep": ("sheep",),
    "cow": ("cow", "cows", "cattle"),
    "elephant": ("elephant", "elephants"),
    "bear": ("bear", "bears"),
    "zebra": ("zebra", "zebras"),
    "giraffe": ("giraffe", "giraffes"),
    "backpack": ("backpack", "backpacks", "rucksack"),
    "umbrella": ("umbrella", "umbrellas"),
    "handbag": ("handbag", "handbags", "purse", "purses", "bag"),
    "tie": ("tie", "ties", "necktie"),
    "suitcase": ("suitcase", "suitcases", "luggage"),
    "frisbee": ("frisbee", "frisbees", "disc"),
    "skis": ("ski", "skis"),
    "snowboard": ("snowboard", "snowboards"),
    "sports ball": ("ball", "balls", "soccer ball", "basketball", "baseball"),
    "kite": ("kite", "kites"),
    "baseball bat": ("baseball bat", "bat", "bats"),
    "baseball glove": ("baseball glove", "glove", "gloves", "mitt"),
    "skateboard": ("skateboard", "skateboards"),
    "surfboard": ("surfboard", "surfboards"),
    "tennis racket": ("tennis racket", "tennis rackets", "racket", "racquet"),
    "bottle": ("bottle", "bottles"),
    "wine glass": ("wine glass", "wine glasses", "goblet"),
    "cup": ("cup", "cups", "mug", "mugs"),
    "fork": ("fork", "forks"),
    "knife": ("knife", "knives"),
    "spoon": ("spoon", "spoons"),
    "bowl": ("bowl", "bowls"),
    "banana": ("banana", "bananas"),
    "apple": ("apple", "apples"),
    "sandwich": ("sandwich", "sandwiches"),
    "orange": ("orange", "oranges"),
    "broccoli": ("broccoli",),
    "carrot": ("carrot", "carrots"),
    "hot dog": ("hot dog", "hot dogs"),
    "pizza": ("pizza", "pizzas"),
    "donut": ("donut", "donuts", "doughnut", "doughnuts"),
    "cake": ("cake", "cakes"),
    "chair": ("chair", "chairs", "seat", "seats"),
    "couch": ("couch", "couches", "sofa", "sofas"),
    "potted plant": ("potted plant", "potted plants", "plant", "plants"),
    "bed": ("bed", "beds"),
    "dining table": ("dining table", "table", "tables", "desk", "desks"),
    "toilet": ("toilet", "toilets"),
    "tv": ("tv", "television", "televisions", "monitor", "screen"),
    "laptop": ("laptop", "laptops", "computer", "computers"),
    "mouse": ("mouse", "computer mouse"),
    "remote": ("remote", "remotes", "controller", "controllers"),
    "keyboard": ("keyboard", "keyboards"),
    "cell phone": ("cell phone", "cell phones", "phone", "phones", "mobile phone"),
    "microwave": ("microwave", "microwaves"),
    "oven": ("oven", "ovens"),
    "toaster": ("toaster", "toasters"),
    "sink": ("sink", "sinks"),
    "refrigerator": ("refrigerator", "refrigerators", "fridge", "fridges"),
    "book": ("book", "books"),
    "clock": ("clock", "clocks"),
    "vase": ("vase", "vases"),
    "scissors": ("scissors",),
    "teddy bear": ("teddy bear", "teddy bears", "teddy"),
    "hair drier": ("hair drier", "hair dryer"),
    "toothbrush": ("toothbrush", "toothbrushes"),
}


def alias_table(spark, categories: list[str], aliases: dict[str, tuple[str, ...]] = CATEGORY_ALIASES) -> DataFrame:
    """(category, alias, rank) of categories in their order; one without aliases is its own name, and that with an s."""
    rows = [(c, a, k) for k, c in enumerate(categories) for a in aliases.get(c, (c, f"{c}s"))]
    return spark.createDataFrame(rows, "category string, alias string, rank int")


def meets_itself(alias: str) -> bool:
    """Whether the words at the alias's begin are also those at its end."""
    words = _WORD.findall(alias)
    return any(words[:n] == words[-n:] for n in range(1, len(words)))


def find_mentions(texts: DataFrame, key: list[str], text: str, aliases: DataFrame) -> DataFrame:
    """(key, category, alias, start, end): the mentions that count, by place in the case-folded text.

    ``aliases`` (category, alias, rank) begin and end with a letter, digit or underscore,
    others are an error; an alias of several categories is of the one of least rank. A
    mention stands between word edges, and those of one alias are looked for from left to
    right. Of those that overlap, in a chain, the longest is taken, of equal ones the first, and what overlaps it is left out, again and again.
    ``key`` tells texts apart. Null texts have no mentions.

    The aliases' numbers of words, and up to ``FEW`` aliases, are read first (two jobs over that table).
    """
    fold = F.udf(str.casefold, "string")
    own = aliases.select("category", fold("alias").alias("alias"), "rank").where("alias is not null")
    counts = own.select(F.size(F.regexp_extract_all("alias", F.lit(r"(?U)\w+"), F.lit(0))).alias("n"), F.col("alias").rlike(r"(?Us)^\w(.*\w)?$").alias("whole")).distinct().collect()
    if not all(r["whole"] for r in counts):
        raise ValueError("an alias has to begin and end with a word character")
    sizes = sorted({r["n"] for r in counts})
    kinds = dict(texts.dtypes)
    # the words of a table of few aliases are looked for while texts are read, and the rest is never sent
    few = [r["alias"] for r in own.select("alias").distinct().limit(FEW + 1).collect()]
    known = set(few) if len(few) <= FEW else None

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                low = (batch.column(len(key))[at].as_py() or "").casefold()
                spans = [m.span() for m in _WORD.finditer(low)]
                found = [(low[s : spans[k + n - 1][1]], s, spans[k + n - 1][1]) for n in sizes for k, (s, _) in enumerate(spans[: len(spans) - n + 1])]
                found = found if known is None else [f for f in found if f[0] in known]
                if found:
                    held = [pa.array([batch.column(c)[at].as_py()] * len(found), batch.column(c).type) for c in range(len(key))]
                    yield pa.record_batch([*held, *(pa.array(x, k) for x, k in zip(zip(*found), (pa.string(), pa.int32(), pa.int32())))], [*key, "alias", "start", "end"])

    runs = texts.select(*key, text).mapInArrow(grams, ", ".join([*(f"`{c}` {kinds[c]}" for c in key), "alias string, start int, end int"]))
    named = own.groupBy("alias").agg(F.min_by("category", "rank").alias("category"))
    hits = runs.join(named.withColumn("_again", F.udf(meets_itself, "boolean")("alias")), "alias")
    # an alias that can overlap itself is found from left to right
    place = F.struct("start", "end")
    selfish = hits.where("_again").groupBy(*key, "alias", "category").agg(F.sort_array(F.collect_list(place)).alias("c"))
    left = F.aggregate("c", F.array().cast(selfish.schema["c"].dataType), lambda kept, m: F.when(F.coalesce(F.try_element_at(kept, F.lit(-1))["end"], F.lit(0)) <= m["start"], F.concat(kept, F.array(m))).otherwise(kept))
    hits = hits.where(~F.col("_again")).select(*key, "alias", "category", "start", "end").union(selfish.select(*key, "alias", "category", F.inline(left)))
    # mentions that overlap in a chain are one cluster, most are alone in theirs
    before = Window.partitionBy(*key).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*key).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hits = hits.withColumn("_new", (F.col("start") >= F.coalesce(F.max("end").over(before), F.lit(0))).cast("int")).withColumn("_cluster", F.sum("_new").over(upto))
    one = F.struct((F.col("start") - F.col("end")).alias("shorter"), "start", "end", "category", "alias")
    chains = hits.groupBy(*key, "_cluster").agg(F.sort_array(F.collect_list(one)).alias("c"))
    clash = lambda kept, m: F.exists(kept, lambda k: (m["start"] < k["end"]) & (k["start"] < m["end"]))
    none = F.array().cast(chains.schema["c"].dataType)
    kept = F.when(F.size("c") == 1, F.col("c")).otherwise(F.aggregate("c", none, lambda kept, m: F.when(clash(kept, m), kept).otherwise(F.concat(kept, F.array(m)))))
    return chains.select(*key, F.inline(kept)).select(*key, "category", "alias", "start", "end")
