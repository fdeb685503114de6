import pytest
from pyspark.sql import functions as F

from jobweave.functions import rules

GOOD = ["Software Engineer II", "Data Scientist", "Software Engineer Intern", "Junior Data Scientist", "Machine Learning New Grad", "Backend Software Engineer", "Data Engineer"]
BAD = ["Senior Data Engineer", "Staff Software Engineer", "Engineering Manager", "Sales Manager", "Software Engineer, Android", "iOS Developer", "Mobile Software Engineer", "React Native Developer", "Flutter Developer", "Frontend Developer", "Front-End Engineer", "Data Analyst", "Junior Data Analyst", "Data Analytics Engineer", "", None]


def values(spark, f, items):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(items)], "i int, x string")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("x"))).collect()]


def test_titles(spark):
    assert values(spark, rules.candidate_title, GOOD) == [True] * len(GOOD)
    assert values(spark, rules.candidate_title, BAD) == [False] * len(BAD)


def test_senior(spark):
    assert values(spark, rules.senior_role, ["Senior Data Engineer", "We are hiring a Senior Staff-level leader", "Software Engineer II", "Senior-mentored internship", None, " "]) == [True, True, False, False, False, False]


def test_experience(spark):
    cases = {"3–5 years' experience": True, "5+ years": True, "at least three years": True, "Five years": True, "100 years of heritage": True, "a 5 year-old product": True, "0-2 years": False, "No prior experience": False, "internship, 5+ years": False, "Two years": False, "12 years ago": False, "30 years old": False, "2-12+ years": False, "": False}
    assert values(spark, rules.too_much_experience, list(cases)) == list(cases.values())


def test_regions(spark):
    assert values(spark, rules.country_in_region, ["Germany", " FRANCE ", "India", None]) == [True, True, False, False]
    assert values(spark, rules.code_in_region, ["GB", "DE", "us", "IN", "uk", None]) == [True, True, False, False, False, False]
    assert values(spark, rules.text_in_region, ["Berlin, Germany", "Malta, NY", "San Francisco, CA", "Krakow", "", None]) == [True, True, False, False, False, False]


def test_other_language_is_exact(spark):
    assert values(spark, rules.requires_other_language, ["English, Dutch", " german ", "English or German", "German (B2)", "", None]) == [True, True, False, False, False, False]
    assert values(spark, rules.excluded_url, ["https://x" + rules.EXCLUDED_URLS[0], "https://x", None]) == [True, False, False]
