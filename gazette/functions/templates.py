"""Titles, descriptions, sections and questions of notices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gazette.functions import exprs

# ---- Fixed values: wording by type ({t} is the title, {y} the year, {s} the site) ----
TITLES = {
    "result": "{t} — Check Result, Merit List & Cut Off Marks", "admit_card": "{t} — Download Hall Ticket & Exam Schedule", "answer_key": "{t} — Download Solution Key & Raise Objections",
    "exam": "{t} — Exam Dates, Schedule & Shift Timing Calendar", "scholarship": "{t} {y} — Eligibility, Grant Amount & Apply Online", "syllabus": "{t} — Complete Exam Pattern & Syllabus PDF",
    "scheme": "{t} — Guidelines, Eligibility & Registration Process",
}
OTHER_TITLE = "{t} — Official Government Notice & Circular"
SECTIONS = {
    "overview": "Overview", "important_dates": "Important Dates", "vacancy_details": "Vacancy Details", "eligibility": "Eligibility", "age_limit": "Age Limit", "application_fee": "Application Fee", "salary": "Salary",
    "selection_process": "Selection Process", "how_to_apply": "How to Apply", "important_links": "Important Official Links", "faq": "Frequently Asked Questions", "disclaimer": "Disclaimer",
}
QUESTIONS = (
    ("application_last_date", "What is the last date to apply?", "The last date to submit the application is {}."),
    ("vacancy", "How many total vacancies are announced?", "A total of {} vacancies have been notified."),
    ("qualification", "What is the required educational qualification?", "{}"),
    ("application_fee", "What is the application fee structure?", "{}"),
    ("exam_date", "When is the examination scheduled?", "The examination date is announced as {}."),
)
# ---- End of fixed values ----


def _filled(template: str, title: Column, year: int) -> Column:
    before, after = template.replace("{y}", str(year)).split("{t}")
    return F.concat(F.lit(before), title, F.lit(after))


def page_title(type_: Column, title: Column, organization: Column, post: Column, vacancy: Column, year: int, most: int = 100) -> Column:
    """Title by type, cut to most characters."""
    short = F.coalesce(F.trim(F.substring_index(organization, "(", 1)), F.lit("Govt"))
    places = F.coalesce(F.concat(F.nullif(vacancy, F.lit("")), F.lit(" Vacancies, ")), F.lit(""))
    job = F.concat(short, F.lit(" "), F.coalesce(post, title), F.lit(f" Recruitment {year} — "), places, F.lit("Eligibility & Apply Online"))
    return F.substring(F.when(type_ == "job", job).otherwise(exprs.lookup(type_, {k: _filled(v, title, year) for k, v in TITLES.items()}, _filled(OTHER_TITLE, title, year))), 1, most)


def job_description(title: Column, organization: Column, post: Column, vacancy: Column, qualification: Column, last_date: Column, year: int, site: str, most: int = 200) -> Column:
    """Description of a job; parts without a value are left out."""
    places = F.coalesce(F.concat(F.nullif(vacancy, F.lit("")), F.lit(" Vacancies for ")), F.lit(""))
    parts = [
        F.concat(F.coalesce(organization, F.lit("Government of India")), F.lit(" announces "), places, F.coalesce(post, title), F.lit(f" posts in {year}.")),
        F.concat(F.lit("Eligibility: "), F.substring(F.nullif(qualification, F.lit("")), 1, 40), F.lit(".")),
        F.concat(F.lit("Last date: "), F.nullif(last_date, F.lit("")), F.lit(".")),
        F.lit(f"Download official notification on {site}."),
    ]
    return F.substring(F.concat_ws(" ", *parts), 1, most)


def sections(markdown: Column) -> list[Column]:
    """A column for each known heading."""
    return [exprs.section(markdown, heading).alias(name) for name, heading in SECTIONS.items()]


def questions(columns: list[str]) -> Column:
    """Questions with an answer from the columns that have a value."""
    parts = []
    for field, question, answer in QUESTIONS:
        if field in columns:
            before, after = answer.split("{}")
            value = F.nullif(F.col(field).cast("string"), F.lit(""))
            parts.append(F.struct(F.lit(question).alias("question"), F.concat(F.lit(before), value, F.lit(after)).alias("answer"), F.lit(field).alias("field")))
    return F.filter(F.array(*parts), lambda p: p["answer"].isNotNull())


def repaired_json(text: Column) -> Column:
    """H2: a model's answer without code fences, control characters and commas before closing brackets."""
    text = F.regexp_replace(F.trim(text), r"(?s)^```[a-z]*\s*|\s*```$", "")
    return F.regexp_replace(F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", " "), r",\s*([}\]])", "$1")
