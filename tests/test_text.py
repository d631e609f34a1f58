"""Normalisation of countries, names and addresses."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftlink.functions import text

NAMES = {
    "Birch Corp": "birch corporation",
    "Birch Corporation": "birch corporation",
    "Larkspur Inc": "larkspur incorporated",
    "Ganga Textiles Pvt Ltd": "ganga textiles private limited",
    "Tern Co": "tern company",
    "Harbour LLC": "harbour llc",
    "Moulin SARL": "moulin sarl",
    "Price & Quine Inc": "price and quine incorporated",
    "C & D Ltd": "c and d limited",
    "NEELAM CORP | www.neelam.example": "neelam corporation",
    "quaysidebooks.com LLC": "quaysidebooks llc",
    "Dental Studio http://smile.org": "dental studio",
    "<< Club Nord >>": "club nord",
    "-- Marsh End Inc Bakery": "marsh end incorporated bakery",
    "Z+ Kitchens Inc": "z and kitchens incorporated",
    "गंगा वस्त्र भंडार": "गंगा वस्त्र भंडार",
    "Café de l'Étang SAS": "café de l étang sas",
    "P.L.C. Mills": "p l c mills",
    "Broad\u00a0Gap\u200bCo": "broad gap company",
    "": "",
    None: "",
}


def _apply(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


def test_names(spark):
    assert dict(zip(NAMES, _apply(spark, NAMES, text.name), strict=True)) == NAMES


def test_countries(spark):
    assert _apply(spark, ["US", "  India  ", "FRANCE", "Germany", None, ""], text.country) == ["us", "india", "france", "germany", "", ""]


ADDRESSES = {
    "Somewhere": ("somewhere", ["somewhere"], None, None, None, None),
    None: ("", [], None, None, None, None),
    " , ,": ("", [], None, None, None, None),
    "2210 Kestrel Dr, Mill Creek, WA": ("2210 kestrel drive mill creek wa", ["2210", "kestrel", "drive"], "mill creek", "wa", None, None),
    "8 Poplar St, Rockford, IL 61101": ("8 poplar street rockford il 61101", ["8", "poplar", "street"], "rockford", "il", "61101", None),
    "Flat 9, Lake View, Siliguri, West Bengal 734001": ("flat 9 lake view siliguri west bengal 734001", ["flat", "9", "lake", "view"], "siliguri", "west bengal 734001", "734001", None),
    "Bundi, Rajasthan, Purane Mandir Ke Pas Gali": ("bundi rajasthan purane mandir ke pas gali", ["bundi"], "rajasthan", "purane mandir ke pas gali", None, "purane mandir ke pas"),
    "12 Boulevard de l'Océan, Brest, Pays-de-Bretagne": ("12 boulevard de l océan brest pays de bretagne", ["12", "boulevard", "de", "l", "océan"], "brest", "pays de bretagne", None, None),
    "TX, Austin, 5 Cedar Ave": ("tx austin 5 cedar avenue", ["5", "cedar", "avenue"], "austin", "tx", None, None),
    "31 Gull Ct, Tampa, FL": ("31 gull court tampa floor", ["31", "gull", "court"], "tampa", "floor", None, None),
    "Rose Villa, Station Road, Behind Old Cinema, Nagpur, Maharashtra": (
        "rose villa station road behind old cinema nagpur maharashtra",
        ["rose", "villa", "station", "road", "behind", "old", "cinema"], "nagpur", "maharashtra", None, "behind old cinema",
    ),
    "40721 Ridgeway Drive": ("40721 ridgeway drive", ["40721", "ridgeway", "drive"], None, None, "40721", None),
    "Unit 6, Fairview": ("unit 6 fairview", ["unit", "6"], "unit 6", "fairview", None, None),
}


def test_addresses(spark):
    got = _apply(spark, ADDRESSES, text.address)
    for want, row in zip(ADDRESSES.items(), got, strict=True):
        assert (row.clean_address, row.street_tokens, row.city, row.state, row.postal_code, row.raw_landmark) == want[1], want[0]


def test_full_stop_blocks_landmark(spark):
    assert _apply(spark, ["Opp. Bank, Pune"], text.address)[0].raw_landmark is None


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(max_size=30), min_size=20, max_size=20))
def test_names_are_squeezed(spark, values):
    values = [v.replace("\x00", "").encode("utf-8", "ignore").decode() for v in values]
    for got in _apply(spark, values, text.name):
        assert got == got.strip() and "  " not in got


@pytest.mark.parametrize("f", [text.name, text.country, text.address_text])
def test_no_python_in_plans(spark, f):
    plan = spark.createDataFrame([("x",)], "v string").select(f(F.col("v")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
