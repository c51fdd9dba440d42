"""Dimensions of fixed size: amounts, classes, states and registration districts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

AMOUNTS = {"overspeed": 700, "triple_riding": 1000, "no_helmet": 500}
CLASSES = ("Plate", "WithHelmet", "WithoutHelmet", "TripleRiding")

_STATES = """
West Bengal WB|Uttarakhand UK UA|Uttar Pradesh UP|Tripura TR|Telangana TS TG|Tamil Nadu TN|Sikkim SK|Rajasthan RJ|Puducherry PY|Punjab PB
Odisha OD OR|Nagaland NL|Mizoram MZ|Meghalaya ML|Manipur MN|Maharashtra MH|Madhya Pradesh MP|Lakshadweep LD|Ladakh LA|Kerala KL|Karnataka KA
Jharkhand JH|Jammu & Kashmir JK|Himachal Pradesh HP|Haryana HR|Gujarat GJ|Goa GA|Delhi DL|Daman & Diu DD|Dadra & Nagar Haveli DN
Chhattisgarh CG|Chandigarh CH|Bihar BR|Assam AS|Arunachal Pradesh AR|Andhra Pradesh AP|Andaman & Nicobar Islands AN
"""

_DISTRICTS = """
AP 16 Vijayawada|TS 09 Hyderabad (Malakpet)|WB 02 Kolkata (Beltala)|RJ 14 Jaipur (South)|HR 26 Gurugram|PB 10 Ludhiana
UP 16 Noida (Gautam Buddha Nagar)|UP 32 Lucknow|GJ 05 Surat|GJ 01 Ahmedabad|MP 04 Bhopal|MP 09 Indore|KL 07 Kochi (Ernakulam)|KL 01 Thiruvananthapuram
TN 09 Chennai (North)|TN 07 Chennai (West)|TN 01 Chennai (Central)|KA 05 Bengaluru (Jayanagar)|KA 03 Bengaluru (Indiranagar)|KA 02 Bengaluru (Rajajinagar)|KA 01 Bengaluru (Koramangala)
DL 07 Delhi (East)|DL 03 Delhi (South)|DL 02 Delhi (New Delhi)|DL 01 Delhi (Central)|MH 43 Navi Mumbai|MH 31 Nagpur|MH 20 Chhatrapati Sambhajinagar (Aurangabad)
MH 14 Pimpri-Chinchwad|MH 12 Pune|MH 05 Kalyan|MH 04 Thane|MH 03 Mumbai (East)|MH 02 Mumbai (West)|MH 01 Mumbai (South)
"""


def state_rows() -> list[tuple[str, str]]:
    """(code, state); a state can have an older code too."""
    out = []
    for entry in _STATES.replace("\n", "|").split("|"):
        words = entry.split()
        codes = [w for w in words if len(w) == 2 and w.isupper()]
        out += [(code, " ".join(w for w in words if w not in codes)) for code in codes]
    return sorted(out)


def district_rows() -> list[tuple[str, str]]:
    """(state and district code, office)."""
    entries = (e.split(" ", 2) for e in _DISTRICTS.replace("\n", "|").split("|") if e)
    return sorted((state + code, name) for state, code, name in entries)


def _table(spark: SparkSession, rows: list[tuple], *columns: str) -> DataFrame:
    """Rows as a relation inside the plan: nothing of them passes a Python worker."""
    literal = lambda v: f"{v}L" if isinstance(v, int) else "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    body = ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({', '.join(columns)})")


def states(spark: SparkSession) -> DataFrame:
    return _table(spark, state_rows(), "state_code", "state")


def districts(spark: SparkSession) -> DataFrame:
    return _table(spark, district_rows(), "code", "district")


def amounts(spark: SparkSession) -> DataFrame:
    return _table(spark, sorted(AMOUNTS.items()), "violation", "fixed")


def classes(spark: SparkSession) -> DataFrame:
    return _table(spark, list(enumerate(CLASSES)), "class_id", "name")
