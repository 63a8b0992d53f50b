"""Label inventory and other word lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The entity types of the annotation scheme.
ENTITY_TYPES = (
    "amount",
    "func.coll", "func.ind",
    "loc.add.elec", "loc.add.phys", "loc.adm.nat", "loc.adm.reg", "loc.adm.sup",
    "loc.adm.town", "loc.fac", "loc.oro", "loc.other", "loc.phys.astro",
    "loc.phys.geo", "loc.phys.hydro", "loc.unk",
    "org.adm", "org.ent",
    "pers.coll", "pers.ind",
    "prod.art", "prod.award", "prod.doctr", "prod.fin", "prod.media",
    "prod.object", "prod.other", "prod.rule", "prod.soft", "prod.serv",
    "time.date.abs", "time.date.rel", "time.hour.abs", "time.hour.rel",
    "loc.unknown", "pers.unknown", "org.unknown", "prod.unknown", "time.unknown",
    "func.unknown", "pers.other", "org.other", "time.other",
)

# The components that occur inside entities.
COMPONENTS = (
    "address-number", "award-cat", "century", "day", "demonym",
    "demonym.nickname", "extractor", "kind", "millenium", "month",
    "name", "name.first", "name.last", "name.middle", "name.nickname",
    "noisy-entities", "object", "other-address-component", "po-box",
    "qualifier", "range-mark", "reference-era", "time-modifier",
    "title", "unit", "val", "week", "year", "zip-code",
)

LABELS = ENTITY_TYPES + COMPONENTS

# Coarse entity types accepted in mention statistics.
COARSE_TYPES = ("pers", "func", "loc", "amount", "time", "org", "prod")

# Pronouns that keep the hyphen of an inverted verb.
HYPHEN_PRONOUNS = ("moi", "toi", "lui", "il", "elle", "vous", "nous", "ce")

# Tokens cut from the edges of an entity.
LEADING_EDGE = ("l'", "L'", "(", "{", '"', "«")
TRAILING_EDGE = (")", "}", '"', "»", ";", ",", ".", "?", "!")

# Label whose top-level annotations count as plain text.
NOISE_LABEL = "noisy-entities"


def label_table(spark: SparkSession) -> DataFrame:
    """The inventory as ``labels(label, kind)``."""
    rows = [(x, "type") for x in ENTITY_TYPES] + [(x, "component") for x in COMPONENTS]
    return spark.createDataFrame(rows, "label string, kind string")
