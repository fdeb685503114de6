"""Rule filters. Each gives true or false, never null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .markup import PYTHON_SPACE
from .text import pattern, strip

# Patterns, names and codes that decide which postings are in scope.
RELEVANT = r"data[\s-]scien|machine[\s-]learning|\bai\b|artificial[\s-]intelligence|\bml\b|data[\s-]engineer|software[\s-]engineer|software[\s-]develop|\bdeveloper\b|backend|back[\s-]end|full[\s-]stack|fullstack|\bprogrammer\b|devops"
EXCLUDED_ROLE = r"\bandroid\b|\bios\b|\breact native\b|\bflutter\b|\bmobile\b|frontend|front[\s-]end|data[\s-]analy"
SENIOR = r"\bsenior\b|\bsr\.?\b|\bstaff\b|\bprincipal\b|\blead\b|\bdirector\b|\bmanager\b|\bvp\b|\bvice president\b|\bchief\b|\bhead of\b"
JUNIOR = r"\bintern(ship)?\b|\bjunior\b|\bjr\.?\b|\bgraduate\b|\bentry[- ]level\b|\bnew grad\b"
YEARS = r"\b(\d{1,2})\s*(?:[-–]|to)?\s*\d{0,2}\+?\s*years?\b"
NUMBER_WORDS = ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten")
NOT_PAST = r"(?!\s*(?:ago|old)\b)"
COUNTRIES = ("albania", "andorra", "austria", "belarus", "belgium", "bosnia and herzegovina", "bulgaria", "croatia", "cyprus", "czech republic", "czechia", "denmark", "estonia", "finland", "france", "germany", "greece", "hungary", "iceland", "ireland", "italy", "kosovo", "latvia", "liechtenstein", "lithuania", "luxembourg", "malta", "moldova", "monaco", "montenegro", "netherlands", "north macedonia", "norway", "poland", "portugal", "romania", "san marino", "serbia", "slovakia", "slovenia", "spain", "sweden", "switzerland", "ukraine", "united kingdom", "vatican city")
COUNTRY_CODES = ("al", "ad", "at", "by", "be", "ba", "bg", "hr", "cy", "cz", "dk", "ee", "fi", "fr", "de", "gr", "hu", "is", "ie", "it", "xk", "lv", "li", "lt", "lu", "mt", "md", "mc", "me", "nl", "mk", "no", "pl", "pt", "ro", "sm", "rs", "sk", "si", "es", "se", "ch", "ua", "gb", "va")
LANGUAGES = ("dutch", "french", "german", "spanish", "italian", "portuguese", "swedish", "norwegian", "danish", "finnish", "polish")
EXCLUDED_LEVELS = ("mid_senior_level", "director", "executive")
EXCLUDED_URLS = ("/nl-NL/vacature/70731/account-support-manager-afh", "/nl-NL/vacature/71574/one-finance-junior-consultant---accenture-consulting", "/en-GB/opportunity/64360/junior-android-developer---mobgen-accenture-interactive")
MAX_YEARS = 2


def word_years() -> str:
    names = "|".join(NUMBER_WORDS)
    return rf"\b({names})\s*(?:[-–]|to)?\s*(?:{names})?\+?\s*years?\b"


def sure(x: Column) -> Column:
    return F.coalesce(x, F.lit(False))


def guarded(regex: str, first: str) -> str:
    """The pattern, tried only where one of these characters stands: all its matches begin with one."""
    return pattern(f"(?=[{first}])(?:{regex})")


def found(x: Column, regex: str, first: str = "") -> Column:
    return sure(x.rlike(guarded(regex, first) if first else pattern(regex)))


def junior_role(x: Column) -> Column:
    return found(x, JUNIOR, "ijgen")


def relevant_title(x: Column) -> Column:
    return found(x, RELEVANT)


def excluded_role(x: Column) -> Column:
    return found(x, EXCLUDED_ROLE)


def senior_role(x: Column) -> Column:
    return found(x, SENIOR, "splmdvch") & ~junior_role(x)


def candidate_title(x: Column) -> Column:
    return relevant_title(x) & ~excluded_role(x) & ~senior_role(x)


def too_much_experience(x: Column, most: int = MAX_YEARS) -> Column:
    """Some 'N years' with N (the low end of a range) over the most, and no junior word anywhere. 'ago' and 'old' don't count."""
    digits = F.exists(F.regexp_extract_all(x, F.lit(guarded(YEARS + NOT_PAST, r"\d")), F.lit(1)), lambda n: n.cast("int") > most)
    words = F.exists(F.regexp_extract_all(x, F.lit(guarded(word_years() + NOT_PAST, "otfsen")), F.lit(1)), lambda n: F.array_position(F.array(*map(F.lit, NUMBER_WORDS)), F.lower(n)) > most)
    # Most texts name no years: a plain search spares them the patterns.
    return sure(F.when(F.contains(F.lower(x), F.lit("year")), (digits | words) & ~junior_role(x)))


def country_in_region(x: Column) -> Column:
    return sure(F.lower(strip(x)).isin(*COUNTRIES))


def code_in_region(x: Column) -> Column:
    return sure(F.lower(strip(x)).isin(*COUNTRY_CODES))


def text_in_region(x: Column) -> Column:
    return sure(F.lower(x).rlike("|".join(COUNTRIES)))


def in_region(source: Column, country: Column, location: Column) -> Column:
    """Each source's rule: by a country's name or code, or by the location's text."""
    return (
        F.when(source.isin("workday", "ashby"), country_in_region(country) | text_in_region(location))
        .when(source == "greenhouse", text_in_region(location))
        .when(source.isin("lever", "smartrecruiters"), code_in_region(country) | text_in_region(location))
        .when(source == "magnetme", country.isNull() | code_in_region(country))
        .otherwise(False)
    )


def excluded_level(x: Column) -> Column:
    return sure(x.isin(*EXCLUDED_LEVELS))


def requires_dutch(languages: Column) -> Column:
    return sure(F.exists(languages, lambda x: F.lower(strip(x)) == "dutch"))


def requires_other_language(x: Column) -> Column:
    """A comma-separated part is exactly one of the listed languages."""
    return sure(F.arrays_overlap(F.transform(F.split(x, ","), lambda t: F.lower(strip(t, PYTHON_SPACE))), F.array(*map(F.lit, LANGUAGES))))


def excluded_url(x: Column) -> Column:
    out = F.lit(False)
    for end in EXCLUDED_URLS:
        out = out | sure(x.endswith(end))
    return out


def has_text(x: Column) -> Column:
    return sure(x.isNotNull() & (x != ""))
