"""Form labels: canonical fields, sensitive labels, slots for secrets, references to them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.text import slug, stripped

# What labels mean is defined by these tables, in this order.
ALIASES = {
    "full_name": ["full name", "name", "your name", "applicant name", "legal name"],
    "first_name": ["first name", "given name", "forename", "first"],
    "last_name": ["last name", "surname", "family name", "last"],
    "email": ["email", "e-mail", "email address"],
    "phone": ["phone", "telephone", "phone number", "mobile", "cell"],
    "address_line1": ["address", "street address", "address line 1", "address 1"],
    "address_line2": ["address line 2", "address 2", "apt", "unit", "suite"],
    "city": ["city", "town", "municipality"],
    "province": ["province", "state", "region", "county"],
    "postal_code": ["postal code", "postcode", "zip", "zip code"],
    "country": ["country", "nation"],
    "date_of_birth": ["date of birth", "dob", "birth date", "birthdate"],
    "occupation": ["occupation", "job title", "profession"],
    "employer": ["employer", "company", "organization"],
    "website": ["website", "url", "web site"],
}
SENSITIVE = [
    "sin", "social insurance", "ssn", "social security", "tax id", "card number", "credit card", "cvv", "cvc", "security code",
    "account number", "routing", "iban", "sort code", "password", "passcode", "pin", "secret", "security answer", "signature", "sign here",
]
SLOTS = [("sin", ["sin", "social_insurance"]), ("ssn", ["ssn", "social_security"]), ("card_number", ["card"]), ("pin", ["pin"]), ("password", ["password", "passcode"])]
REFERENCE = r"(?i)^vault:([a-z0-9_.-]{1,64})$"


def cleaned(label: Column) -> Column:
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(label), "[^a-z0-9 ]+", " ")), " +", " ")


def field_of(label: Column, whole_words: bool = False) -> Column:
    """Canonical field of a label, or null: exact names first, then the first alias that the label contains.

    Containment ignores word borders, as the tables' meaning does ("Community" holds "unit");
    whole_words asks for them instead.
    """
    exact: dict[str, str] = {k: k for k in ALIASES}
    for key, names in ALIASES.items():
        for name in [key.replace("_", " "), *names]:
            exact.setdefault(name, key)
    known = F.create_map(*(F.lit(x) for pair in exact.items() for x in pair))

    def of(text: Column) -> Column:
        padded = F.concat(F.lit(" "), text, F.lit(" "))
        has = (lambda a: F.contains(padded, F.lit(f" {a} "))) if whole_words else (lambda a: F.contains(text, F.lit(a)))
        return F.coalesce(known[text], *(F.when(has(a), F.lit(key)) for key, names in ALIASES.items() for a in names))

    # Inside the lambda the label is cleaned once, not once an alias.
    return F.get(F.transform(F.array(cleaned(label)), of), F.lit(0))


def field_or_slug(label: Column) -> Column:
    return F.coalesce(field_of(label), F.replace(stripped(F.lower(label)), F.lit(" "), F.lit("_")))


def sensitive(label: Column) -> Column:
    """Whether a fragment is anywhere in the label; one search for all."""
    return F.lower(label).rlike("|".join(SENSITIVE))


def suggested_slot(label: Column) -> Column:
    text = slug(label)
    cases = [F.when(text.rlike("|".join(parts)), F.lit(name)) for name, parts in SLOTS]
    return F.coalesce(*cases, F.when(text != "", F.left(text, F.lit(40))), F.lit("secret"))


def slot_for(label: Column, names: Column) -> Column:
    """Of the stored names the suggested one, else the first that holds the label's slug or is held by it."""
    text = slug(label)
    either = F.filter(names, lambda n: F.contains(text, n) | F.contains(n, text))
    return F.when(F.array_contains(names, suggested_slot(label)), suggested_slot(label)).otherwise(F.get(either, F.lit(0)))


def is_reference(value: Column) -> Column:
    return stripped(value).rlike(REFERENCE)
