"""Relations between mentions of a text (J9, X11-X15), span and mention dedupe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import text as tx

# Fixed values: (signals, predicate, boost), checked in this order on lower-cased text between two mentions (Q22).
PATTERNS = [
    (["lives in", "vive en", "reside in", "based in", "located in", "ubicado en"], "lives_in", 0.3),
    (["moved to", "se mudó a", "relocated to", "trasladó a"], "moved_to", 0.3),
    (["moved from", "se mudó de", "came from", "vino de"], "moved_from", 0.3),
    (["born in", "nació en", "nacido en"], "born_in", 0.3),
    (["traveled to", "viajó a", "went to", "fue a"], "traveled_to", 0.2),
    (["works at", "trabaja en", "employed at", "employed by"], "works_at", 0.3),
    (["works for", "trabaja para"], "works_for", 0.3),
    (["founded", "fundó", "created", "creó", "started"], "founded", 0.3),
    (["leads", "lidera", "heads", "dirige", "manages", "gestiona"], "leads", 0.25),
    (["joined", "se unió a", "ingresó a"], "joined", 0.25),
    (["CEO of", "director of", "president of"], "leads", 0.3),
    (["married to", "casado con", "spouse of", "esposo de", "esposa de"], "married_to", 0.3),
    (["friend of", "amigo de", "amiga de"], "friend_of", 0.2),
    (["sibling of", "hermano de", "hermana de", "brother of", "sister of"], "sibling_of", 0.3),
    (["child of", "hijo de", "hija de", "son of", "daughter of"], "child_of", 0.3),
    (["parent of", "padre de", "madre de", "father of", "mother of"], "parent_of", 0.3),
    (["owns", "posee", "has", "tiene"], "owns", 0.15),
    (["bought", "compró", "acquired", "adquirió", "purchased"], "acquired", 0.25),
    (["wrote", "escribió", "authored", "publicó", "published"], "authored", 0.25),
    (["caused", "causó", "led to", "provocó", "resulted in"], "caused_by", 0.25),
    (["after", "después de", "following", "tras"], "follows", 0.1),
    (["before", "antes de", "prior to"], "precedes", 0.1),
    (["met", "conoció", "met with", "se reunió con"], "met", 0.2),
    (["called", "llamó", "contacted", "contactó"], "contacted", 0.2),
    (["said", "dijo", "told", "told to"], "communicated_with", 0.1),
    (["ate", "comió", "eaten", "eating", "comiendo"], "ate", 0.2),
    (["with", "con", "junto a", "along with"], "associated_with", 0.05),
    (["in", "en", "at", "a"], "located_in", 0.05),
]
# Predicates that map to an edge type other than RelatesTo.
EDGE_OF = {"CausedBy": ["caused", "caused_by", "leads_to"], "ConflictsWith": ["conflicts_with", "contradicts"], "NextEpisode": ["follows", "precedes", "next"], "HasProperty": ["has", "has_property", "owns"], "Supersedes": ["supersedes", "replaces"]}
MAX_DISTANCE, LEAST = 200, 0.1


def predicate(between) -> Column:
    """``struct<name, boost>`` of the first row of which a signal is in the text; else related_to, 0."""
    t = tx.key(between)
    out = [F.when(F.greatest(*[t.contains(s) for s in signals]) if len(signals) > 1 else t.contains(signals[0]), F.struct(F.lit(name).alias("name"), F.lit(boost).alias("boost"))) for signals, name, boost in PATTERNS]
    return F.coalesce(*out, F.struct(F.lit("related_to").alias("name"), F.lit(0.0).alias("boost")))


def edge_type(name) -> Column:
    """X15."""
    lowered = F.lower(F.col(name) if isinstance(name, str) else name)
    out = F
    for kind, names in EDGE_OF.items():
        out = out.when(lowered.isin(*names), kind)
    return out.otherwise("RelatesTo")


def proximity(distance, most: int = MAX_DISTANCE) -> Column:
    """1 at 0, falling to 0 at ``most``."""
    d = F.col(distance) if isinstance(distance, str) else distance
    return F.when(d <= 0, 1.0).when(d >= most, 0.0).otherwise(1 - d / float(most))


def pairs(mentions: DataFrame, most: int = MAX_DISTANCE) -> DataFrame:
    """Mention pairs of a text in order of start, not overlapping, at most ``most`` apart.

    A bucketed range join: the later mention's start lies in the earlier end's bucket or the next,
    so a text with very many mentions is spread over buckets.
    """
    first = mentions.select("text_id", *[F.col(c).alias(f"a_{c}") for c in ("text", "label", "start", "end", "confidence")])
    second = mentions.select("text_id", *[F.col(c).alias(f"b_{c}") for c in ("text", "label", "start", "end", "confidence")])
    first = first.withColumn("_bucket", F.explode(F.array(F.floor(F.col("a_end") / (most + 1)), F.floor(F.col("a_end") / (most + 1)) + 1)))
    second = second.withColumn("_bucket", F.floor(F.col("b_start") / (most + 1)))
    gap = F.col("b_start") - F.col("a_end")
    return first.join(second, ["text_id", "_bucket"]).where((gap >= 0) & (gap <= most)).drop("_bucket").withColumn("distance", gap)


def subject_first(a_label, b_label, name) -> Column:
    """Whether the earlier mention is the subject: for places a person before a location, else a person first, else the earlier."""
    a, b = F.lower(a_label), F.lower(b_label)
    spatial = name.isin("lives_in", "moved_to", "moved_from", "born_in", "traveled_to", "located_in")
    return F.when(spatial & (a == "location") & (b == "person"), False).when((b == "person") & (a != "person"), False).otherwise(True)


def co_occurrence(mentions: DataFrame, texts: DataFrame, most: int = MAX_DISTANCE, least: float = LEAST) -> DataFrame:
    """X11: ``(text_id, subject, predicate, object, confidence)`` from mentions and ``texts(text_id, body)``.

    Confidence is min(1, 0.5 x proximity + boost + 0.2 x sqrt of both confidences); below ``least`` goes;
    of a (subject, object) the surest stays.
    """
    joined = pairs(mentions, most).join(texts, "text_id")
    between = F.substring(F.col("body"), F.col("a_end") + 1, F.greatest(F.col("distance"), F.lit(0)))
    found = joined.withColumn("p", predicate(between)).withColumn("ahead", subject_first(F.col("a_label"), F.col("b_label"), F.col("p.name")))
    sure = F.least(F.lit(1.0), 0.5 * proximity("distance", most) + F.col("p.boost") + 0.2 * F.sqrt(F.col("a_confidence") * F.col("b_confidence")))
    rows = found.select("text_id", F.when(F.col("ahead"), F.col("a_text")).otherwise(F.col("b_text")).alias("subject"), F.col("p.name").alias("predicate"), F.when(F.col("ahead"), F.col("b_text")).otherwise(F.col("a_text")).alias("object"), sure.alias("confidence"), F.col("a_start").alias("_a"), F.col("b_start").alias("_b"))
    best = rows.where(F.col("confidence") >= least).groupBy("text_id", "subject", "object").agg(F.max_by(F.struct("predicate", "confidence"), F.struct("confidence", -F.col("_a"), -F.col("_b"))).alias("m"))
    return best.select("text_id", "subject", "m.predicate", "object", "m.confidence")


def distinct_mentions(mentions: DataFrame) -> DataFrame:
    """A10: one row per normalised name: the first occurrence's text, the largest confidence and its label (earliest of ties)."""
    order = F.struct("text_id", "start")
    keyed = mentions.withColumn("key", tx.key("text"))
    out = keyed.groupBy("key").agg(F.min_by("text", order).alias("text"), F.max("confidence").alias("confidence"), F.max_by("label", F.struct("confidence", -F.col("text_id"), -F.col("start"))).alias("label"), F.count(F.lit(1)).alias("mentions"))
    return out


def greedy_spans(spans) -> Column:
    """Of ``array<struct<start, end, confidence, ...>>``, by falling confidence, those that overlap none taken; in order of start."""
    s = F.col(spans) if isinstance(spans, str) else spans
    order = lambda a, b: F.when(a["confidence"] > b["confidence"], -1).when(a["confidence"] < b["confidence"], 1).when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(0)
    taken = F.aggregate(
        F.array_sort(s, order), F.slice(s, 1, 0),
        lambda kept, x: F.when(F.exists(kept, lambda k: (k["start"] < x["end"]) & (x["start"] < k["end"])), kept).otherwise(F.concat(kept, F.array(x))),
    )
    return F.array_sort(taken, lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(0))


def parse_relations(rows: DataFrame, output: str = "output") -> DataFrame:
    """The relations in a model's answer: what stands from the first ``[`` to the last ``]``, read as JSON.

    Adds ``subject, predicate, object, confidence`` and gives a row a relation; elements whose
    subject, predicate or object is no string are skipped, a confidence that is no number is 0.5,
    and it is held within 0 and 1.  An answer without a readable array gives no row.
    """
    span = F.regexp_extract(F.col(output), r"(?s)\[.*\]", 0)
    found = F.explode(F.try_variant_get(F.try_parse_json(F.when(span != "", span)), "$", "array<variant>")).alias("_r")
    part = lambda name: F.try_variant_get("_r", f"$.{name}", "variant")
    string = lambda name: F.when(F.schema_of_variant(part(name)) == "STRING", F.try_variant_get("_r", f"$.{name}", "string"))
    number = F.when(F.schema_of_variant(part("confidence")).rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT)"), F.try_variant_get("_r", "$.confidence", "double"))
    out = rows.select("*", found)
    out = out.select(*rows.columns, *[string(n).alias(n) for n in ("subject", "predicate", "object")], F.least(F.greatest(F.coalesce(number, F.lit(0.5)), F.lit(0.0)), F.lit(1.0)).alias("confidence"))
    return out.where("subject is not null and predicate is not null and object is not null")


def with_fallback(first: DataFrame, other: DataFrame, key: str = "text_id") -> DataFrame:
    """The relations of the first extractor, and those of the other for texts of which the first has none."""
    rest = other.join(first.select(key).distinct(), key, "left_anti")
    return first.unionByName(rest.select(*first.columns))


def resolved(found: DataFrame, entities: DataFrame) -> DataFrame:
    """``(source, target, edge_type, weight, predicate, source_chunk)`` of relations ``(text_id, subject, predicate, object, confidence)``.

    Subject and object are looked up among ``entities`` ``(id, content)`` by normalised name; a
    relation with an end that no entity has is dropped.  Of entities of one name the least id holds.
    """
    ids = entities.groupBy(tx.key("content").alias("key")).agg(F.min("id").alias("id")).where("key is not null")
    rows = found.withColumn("_s", tx.key("subject")).withColumn("_o", tx.key("object"))
    rows = rows.join(ids.select(F.col("key").alias("_s"), F.col("id").alias("source")), "_s").join(ids.select(F.col("key").alias("_o"), F.col("id").alias("target")), "_o")
    return rows.select("source", "target", edge_type("predicate").alias("edge_type"), F.col("confidence").alias("weight"), "predicate", F.col("text_id").alias("source_chunk"))


def mention_links(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """A RelatesTo edge of weight 1 from each text to each entity that it mentions, once; unknown names give none."""
    ids = entities.groupBy(tx.key("content").alias("key")).agg(F.min("id").alias("id")).where("key is not null")
    rows = mentions.select(F.col("text_id").alias("source"), tx.key("text").alias("key")).distinct().join(ids, "key")
    return rows.select("source", F.col("id").alias("target"), F.lit("RelatesTo").alias("edge_type"), F.lit(1.0).alias("weight"))
