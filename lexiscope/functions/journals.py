"""Journal classes by name: an exact table, then ordered rules of substrings, compiled to one CASE."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Titles and their class.
TITLES = {
    "Nature": "Multidisciplinary", "Science": "Multidisciplinary", "Cell": "Cell & Dev Biology", "Blood": "Clinical Medicine", "Gut": "Clinical Medicine",
    "Pain": "Neuroscience", "Brain": "Neuroscience", "Neurology": "Neuroscience", "Circulation": "Cardiology & Vasc", "Lancet": "Clinical Medicine",
    "Langmuir": "Chemistry & Materials", "Small": "Chemistry & Materials", "Leukemia": "Oncology", "Stroke": "Cardiology & Vasc", "Diabetes": "Clinical Medicine",
    "Oncogene": "Oncology", "Immunity": "Immunology", "Neuron": "Neuroscience", "Bone": "Clinical Medicine", "Nanoscale": "Chemistry & Materials",
    "RNA": "Biochemistry & Mol Bio", "Structure": "Biochemistry & Mol Bio", "Gut Microbes": "Biochemistry & Mol Bio",
}
# Classes in order, with the substrings of lower-case names that give them.
RULES = {
    "Genetics & Genomics": ["genet", "genom", "hered", "mutat", "chromosom", "cytogenet", "bioinform"],
    "Neuroscience": ["neuro", "brain", "psychiatr", "psychol", "epilep", "cephalalg", "alzheim"],
    "Oncology": ["cancer", "oncol", "tumor", "tumour", "carcinogen", "anticancer", "leuk", "lymphom"],
    "Immunology": ["immunol", "allerg", "mucosal"],
    "Cell & Dev Biology": [
        "cell biol", "dev biol", "stem cell", "cell death", "develop", "embryol", "tissue eng", "reprod biol", "cell mol", "cell res", "cell prolif", "cell commun",
        "cell cycle", "cell tissue", "cell metab", "cell rep", "cell stem", "cell genom",
    ],
    "Biochemistry & Mol Bio": [
        "biochem", "mol biol", "biol chem", "biophys", "febs", "faseb", "proteom", "glycobiol", "nucleic acid", "mol microbiol", "mol ecol", "mol endocrinol",
        "mol pharmacol", "mol cell", "mol syst", "mol med",
    ],
    "Pharmacology & Toxicology": ["pharmacol", "toxicol", "xenobiotica", "antimicrob", "drug", "pharm"],
    "Cardiology & Vasc": ["cardiol", "heart", "hypertens", "cardiovasc", "thromb", "vasc", "arteri"],
    "Chemistry & Materials": ["chem", "nano", "polym", "colloid", "mater", "beilstein", "chirality", "ultrason"],
    "Clinical Medicine": [
        "clin", "intern med", "n engl j med", "jama", "hosp", "surg", "obstet", "pediatr", "nephrol", "hepatol", "gastroent", "ophthalm", "dermatol", "anesth", "emerg",
        "radiol", "urol", "rheumatol", "endocr", "diabet", "kidney", "liver", "infect", "transplant", "forensic", "nutr", "phytother", "planta med", "fitoterap", "vet ",
        "environ health",
    ],
    "Multidisciplinary": [
        "plos", "sci rep", "nat commun", "elife", "proc natl acad", "bmc", "int j mol sci", "front ", "biomed res", "commun biol", "sci adv", "peerj", "gigascience",
        "sci data", "adv sci",
    ],
}
OTHER = "Other"
CLASSES = [*RULES, OTHER]


def classify(name: Column) -> Column:
    """The class of a journal name; Other for null, blank, Unknown and names that no rule knows."""
    exact = F.create_map(*(F.lit(x) for pair in TITLES.items() for x in pair))
    lower = F.lower(name)
    by_rule = F  # the first call of when() is the module's, later ones the column's
    for label, parts in RULES.items():
        found = lower.contains(parts[0])
        for part in parts[1:]:
            found = found | lower.contains(part)
        by_rule = by_rule.when(found, label)
    known = name.isNotNull() & (name != "") & (name != "Unknown")
    return F.when(known, F.coalesce(F.try_element_at(exact, name), by_rule.otherwise(OTHER))).otherwise(OTHER)


def class_percentages(shares: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, journal_class, percent)`` of ``shares(keys, key, proportion)``: all classes, one digit; names that
    are unknown don't count, and all are 0 where nothing counts."""
    counted = shares.filter("key is not null and key != 'Unknown'").groupBy(*keys, classify(F.col("key")).alias("journal_class")).agg(F.sum("proportion").alias("w"))
    every = shares.select(*keys).distinct().withColumn("journal_class", F.explode(F.array(*map(F.lit, CLASSES))))
    rows = every.join(counted, [*keys, "journal_class"], "left").withColumn("w", F.coalesce("w", F.lit(0.0)))
    total = rows.groupBy(*keys).agg(F.sum("w").alias("total"))
    return rows.join(total, keys).select(*keys, "journal_class", F.round(F.when(F.col("total") > 0, F.col("w") / F.col("total") * 100).otherwise(0.0), 1).alias("percent"))
