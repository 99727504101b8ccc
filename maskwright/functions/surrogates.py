"""Invented values that stand for real ones, the same each time for one seed, category and value.

A surrogate is a function of a hash of its key, so tasks mint alike without talking to each other. Each draw is the
first 32 bits of the MD5 of the key and the draw's number, modulo the size of what it is drawn from.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names follow a rule: every first part with every second.
FORENAMES = [a + b for a in ("Al", "Be", "Ca", "Da", "El", "Fa", "Ge", "Ha", "Il", "Jo", "Ka", "Lu", "Ma", "Ne", "Ol") for b in ("bin", "dra", "len", "mir", "na", "nor", "ra", "ric", "sa", "ton", "vin", "ya")]
SURNAMES = [a + b for a in ("Ash", "Bran", "Cold", "Dun", "East", "Fern", "Glen", "Hart", "Kirk", "Lang", "Mill", "North", "Oak", "Pem", "Rock") for b in ("bridge", "by", "dale", "field", "ford", "ham", "ley", "more", "shaw", "stone", "ton", "wood")]
STREETS = ["Amber", "Beacon", "Canal", "Dover", "Ember", "Falcon", "Garnet", "Harvest", "Island", "Jasmine", "Kestrel", "Lantern", "Meridian", "Nettle", "Orchard", "Pebble", "Quarry", "Raven", "Saffron", "Timber", "Umber", "Valley", "Walnut", "Yarrow"]
STREET_KINDS = ["Street", "Avenue", "Road", "Lane", "Drive", "Court", "Crescent", "Close"]
DOMAINS = ["example.com", "example.org", "example.net", "mail.example", "post.example", "letters.example", "inbox.example"]
URL_WORDS = ["alder", "breeze", "cobalt", "dune", "echo", "flint", "grove", "heron", "iris", "jade", "kelp", "larch", "moss", "nimbus", "opal", "pine"]
ALNUM = list("abcdefghijklmnopqrstuvwxyz0123456789")


def draw(key: Column, number: int, size: int) -> Column:
    """A whole number below ``size``."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat(key, F.lit(f"|{number}")).cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(size))


def _pick(key: Column, number: int, items: list[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, items)), (draw(key, number, len(items)) + 1).cast("int"))


def _padded(n: Column, width: int) -> Column:
    return F.lpad(n.cast("string"), width, "0")


def key(seed: int, category: Column, real: Column, attempt: Column) -> Column:
    return F.concat_ws("|", F.lit(str(seed)), category, real, attempt.cast("string"))


def surrogate(category: Column, real: Column, attempt: Column, seed: int = 0) -> Column:
    """The surrogate of a value; each ``attempt`` gives another. A category that isn't known gets one like a secret's."""
    k = key(seed, category, real, attempt)
    first, last = _pick(k, 0, FORENAMES), _pick(k, 1, SURNAMES)
    forms = {
        "private_person": F.concat(first, F.lit(" "), last),
        "private_email": F.concat(F.lower(first), F.lit("."), F.lower(last), _padded(draw(k, 2, 100), 2), F.lit("@"), _pick(k, 3, DOMAINS)),
        "private_phone": F.concat(F.lit("("), draw(k, 0, 800) + 200, F.lit(") "), draw(k, 1, 800) + 200, F.lit("-"), _padded(draw(k, 2, 10_000), 4)),
        "private_address": F.concat(draw(k, 0, 9899) + 1, F.lit(" "), _pick(k, 1, STREETS), F.lit(" "), _pick(k, 2, STREET_KINDS)),
        "private_date": F.concat(draw(k, 0, 150) + 1900, F.lit("-"), _padded(draw(k, 1, 12) + 1, 2), F.lit("-"), _padded(draw(k, 2, 28) + 1, 2)),
        "private_url": F.concat(F.lit("https://"), _pick(k, 0, DOMAINS), F.lit("/"), _pick(k, 1, URL_WORDS), F.lit("-"), _pick(k, 2, URL_WORDS), F.lit("-"), _padded(draw(k, 3, 100_000), 5)),
        "account_number": F.concat(_padded(draw(k, 0, 100_000), 5), _padded(draw(k, 1, 100_000), 5)),
        "secret": F.concat(F.lit("sk-fake-"), *[_pick(k, i, ALNUM) for i in range(16)]),
    }
    out = forms["secret"]
    for name, form in forms.items():
        out = F.when(category == name, form).otherwise(out)
    return out
