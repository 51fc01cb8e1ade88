"""Column-name vocabulary and its classification as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Canonical index names and the patterns that recognise them, in
# the order they are tried, then the patterns of the other roles.
INDEX_PATTERNS = {
    "NDVI": r"\bnd\s*_?vi\b|normali[sz]ed.*vegetation|\bndvi\b",
    "NDBI": r"\bndbi\b|normali[sz]ed.*built",
    "NDWI": r"\bndwi\b|normali[sz]ed.*water",
    "MNDWI": r"\bmndwi\b|modified.*water",
    "NDBaI": r"\bndbai\b|\bndbal\b|bare\s*soil",
    "SAVI": r"\bsavi\b|soil.*adjusted",
    "EVI": r"\bevi\b|enhanced.*vegetation",
    "MSAVI": r"\bmsavi\b",
    "IBI": r"\bibi\b|index.*based.*built",
    "UI": r"\bui\b|urban\s*index",
    "BUI": r"\bbui\b|built.?up\s*index",
    "BSI": r"\bbsi\b|bare\s*soil\s*index",
    "NBR": r"\bnbr\b|burn\s*ratio",
    "ALBEDO": r"albedo",
    "EMISS": r"emissiv|\beps\b|\bemis\b",
    "FVC": r"\bfvc\b|fraction.*veg|veg.*fraction|\bpv\b",
    "IMPERV": r"imperv|\bisa\b|sealed",
    "ELEV": r"\belev\b|\bdem\b|altitude|\bsrtm\b",
    "SLOPE": r"\bslope\b",
    "NDMI": r"\bndmi\b|moisture\s*index",
    "LAI": r"\blai\b|leaf\s*area",
    "TCW": r"\btcw\b|tasselled.*wet",
    "TCG": r"\btcg\b|tasselled.*green",
    "TCB": r"\btcb\b|tasselled.*bright",
}
LST_PATTERN = r"\blst\b|land\s*surface\s*temp|surface\s*temp|\btemp\b|\bbt\b|bright.*temp|\bts\b"
LAT_PATTERN = (r"^lat\b|latitude|\by\s*coord|\bcoord\s*y\b|\bnorthing\b|"
               r"^point\s*y$|^y$|^ycoord|\byutm\b")
LON_PATTERN = (r"^lon\b|^lng\b|longitude|\bx\s*coord|\bcoord\s*x\b|\beasting\b|"
               r"^point\s*x$|^x$|^xcoord|\bxutm\b")
YEAR_PATTERN = r"^year$|^yr$|^date$|^time$|^epoch$|^acq"
ID_PATTERN = r"^id$|^fid$|^oid$|^objectid$|^index$|unnamed|^system:index$|\.geo$"
ZONE_PATTERN = r"zone|ward|thana|district|city\s*corp|dncc|dscc|region|area\s*name|name$"
YEAR_COLUMN = r"(19|20)\d{2}"
TREND_NAME = r"trend|1990|time.?series|annual"
# Indices kept in their own unit when stored values are rescaled.
UNSCALED = ("ELEV", "SLOPE", "LAI")
# Zone labels by what the lower-cased table name contains, tried in order.
ZONE_LABELS = [(("dncc", "north"), "North (DNCC)"), (("dscc", "south"), "South (DSCC)")]
UNASSIGNED = "Unassigned"
# A name that also fits a broader pattern placed before its own.
MORE_SPECIFIC = {"MNDWI": "NDWI", "BSI": "NDBaI"}


def normalise(name: str) -> str:
    """The driver-side form of :func:`normalised`, for single names."""
    return re.sub(r"[^a-z0-9]+", " ", name.lower()).strip()


def normalised(name: Column) -> Column:
    """Lower case, runs of other characters than a-z and 0-9 to one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", " "))


def index_order(specific_first: bool = False) -> list[str]:
    """Index names as tried; ``specific_first`` puts e.g. BSI ahead of bare soil."""
    names = list(INDEX_PATTERNS)
    if specific_first:
        for name, broader in MORE_SPECIFIC.items():
            names.remove(name)
            names.insert(names.index(broader), name)
    return names


def classify(df: DataFrame, column: str, out: str = "named", specific_first: bool = False) -> DataFrame:
    """Add ``out``, a struct of ``role`` and ``canonical`` for the column name in ``column``.

    The normalised name is a column of its own, so that it is computed once and
    not for each of the patterns.
    """
    n = F.col("__normal")

    def struct(role, canonical=None):
        return F.struct(F.lit(role).alias("role"), F.lit(canonical).cast("string").alias("canonical"))

    c = F.when(n.rlike(ID_PATTERN) | F.lower(column).rlike(ID_PATTERN), struct("id"))
    c = c.when(n.rlike(YEAR_PATTERN), struct("year", "YEAR"))
    c = c.when(n.rlike(LAT_PATTERN), struct("lat", "LAT"))
    c = c.when(n.rlike(LON_PATTERN), struct("lon", "LON"))
    for canonical in index_order(specific_first):
        c = c.when(n.rlike(INDEX_PATTERNS[canonical]), struct("index", canonical))
    c = c.when(n.rlike(LST_PATTERN), struct("lst", "LST"))
    c = c.when(n.rlike(ZONE_PATTERN), struct("zone", "ZONE")).otherwise(struct("other"))
    return df.withColumn("__normal", normalised(F.col(column))).withColumn(out, c).drop("__normal")


def zone_label(name: Column, rules=ZONE_LABELS, default: str = UNASSIGNED) -> Column:
    """Zone of a table name; the first rule with a contained word wins."""
    low = F.lower(name)
    out = None
    for words, label in rules:
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(default)
