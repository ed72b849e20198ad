"""Term tables and their matching.

A table of terms is a literal array in the plan: one pass over the text, no
shuffle. Matching is by substring of the lower-cased text, in table order.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Terms, labels and weights of the epidemic lexicon.
DISEASE_TERMS = {
    "DBD": ["dbd", "demam berdarah", "dengue"],
    "Mpox": ["mpox", "monkeypox"],
    "Flu Burung": ["flu burung", "avian influenza", "bird flu"],
    "Antraks": ["antraks", "anthrax"],
    "Campak": ["campak", "measles"],
    "Rubela": ["rubela", "rubella"],
    "Diare": ["diare", "diarrhea", "diarrhoea"],
    "Kolera": ["kolera", "cholera"],
    "Demam Tifoid": ["demam tifoid", "tifoid", "typhoid"],
    "Chikungunya": ["chikungunya"],
    "Superflu": ["superflu"],
    "Avian Influenza": ["avian influenza", "flu burung", "bird flu"],
    "Nipah": ["nipah"],
    "TBC": ["tbc", "tb", "tuberkulosis", "tuberculosis"],
    "HIV": ["hiv"],
    "AIDS": ["aids"],
    "IMS": ["ims", "infeksi menular seksual", "std", "sti"],
    "Polio": ["polio"],
    "Difteri": ["difteri", "diphtheria"],
    "Batuk Renjan": ["batuk renjan", "pertusis", "pertussis"],
    "Rabies": ["rabies"],
    "Leptospirosis": ["leptospirosis"],
    "KLB Penyakit": ["klb penyakit", "kejadian luar biasa"],
}
EVENT_TERMS = {
    "outbreak": ["wabah", "klb", "kejadian luar biasa", "merebak", "meluas"],
    "death": ["meninggal", "tewas", "kematian", "fatal"],
    "increase": ["meningkat", "naik", "lonjakan", "bertambah"],
    "alert": ["waspada", "darurat", "siaga", "peringatan"],
    "case_report": ["kasus", "terdeteksi", "ditemukan", "dilaporkan", "positif"],
}
EVENT_SEVERITY = {"outbreak": 30, "death": 30, "increase": 20, "alert": 15, "case_report": 10}
EVENT_SCORE = {"outbreak": 25, "death": 25, "increase": 15, "alert": 15, "case_report": 10}
DISEASE_SCORE = {
    "dbd": 25, "demam berdarah": 25, "dengue": 25, "mpox": 30, "monkeypox": 30, "flu burung": 35, "avian influenza": 35, "bird flu": 35, "antraks": 35, "anthrax": 35,
    "rabies": 30, "polio": 35, "difteri": 30, "campak": 25, "rubela": 20, "diare": 15, "kolera": 35, "tifoid": 20, "demam tifoid": 20, "chikungunya": 25,
    "leptospirosis": 30, "nipah": 40, "tbc": 20, "tuberkulosis": 20, "hiv": 20, "aids": 20, "ims": 15, "infeksi menular seksual": 15, "pertusis": 25, "batuk rejan": 25,
}
KEYWORD_SCORE = {
    "klb": 30, "kejadian luar biasa": 30, "wabah": 25, "meninggal": 25, "kematian": 25, "tewas": 25, "darurat": 20, "waspada": 15,
    "meningkat": 15, "lonjakan": 20, "merebak": 20, "meluas": 20, "suspek": 10, "positif": 10, "dirawat": 10,
}
HIGH_WORDS = ["klb", "kejadian luar biasa", "wabah", "meninggal", "kematian", "meningkat", "lonjakan", "merebak", "terjangkit", "kasus bertambah", "dirawat", "isolasi", "suspek", "positif"]
LOW_WORDS = ["sosialisasi", "edukasi", "penyuluhan", "seminar", "pelatihan", "imbauan", "kampanye", "peringatan hari", "lomba", "donor darah"]


def any_of(text: Column, words: list[str]) -> Column:
    """Whether one of the words is a substring."""
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def labels(text: Column, terms: dict[str, list[str]]) -> Column:
    """The labels with a term in the text, in table order."""
    return F.array_compact(F.array(*[F.when(any_of(text, variants), F.lit(label)) for label, variants in terms.items()]))


def weights(text: Column, terms: dict[str, int]) -> Column:
    """The summed weights of the terms in the text, a plain column: it is read once for each term."""
    out = F.lit(0)
    for t, w in terms.items():
        out = out + F.when(F.contains(text, F.lit(t)), w).otherwise(0)
    return out


def first_weight(text: Column, terms: dict[str, int]) -> Column:
    """(term, weight) of the first term in table order that the text has; null without one."""
    out = None
    for t, w in terms.items():
        row = F.struct(F.lit(t).alias("term"), F.lit(w).alias("weight"))
        out = F.when(F.contains(text, F.lit(t)), row) if out is None else out.when(F.contains(text, F.lit(t)), row)
    return out


# The same in DuckDB.
def any_sql(text: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


def labels_sql(text: str, terms: dict[str, list[str]]) -> str:
    rows = ", ".join(f"CASE WHEN {any_sql(text, v)} THEN '{k}' END" for k, v in terms.items())
    return f"list_filter([{rows}], lambda x: x IS NOT NULL)"


def values_sql(terms: dict[str, int]) -> str:
    return "(VALUES " + ", ".join(f"({i}, '{t}', {w})" for i, (t, w) in enumerate(terms.items())) + ")"
