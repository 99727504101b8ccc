"""What the pattern pass recognises, and its single combined expression.

The patterns of one category stand together, so eight groups tell them apart; of several that match at one place the
first in this order wins, and the text is scanned once from left to right.
"""

from __future__ import annotations

#: The eight categories, in the order in which reports list them.
CATEGORIES = (
    "account_number", "private_address", "private_date", "private_email",
    "private_person", "private_phone", "private_url", "secret",
)

# The recognised formats, in order of priority.
SECRET = [
    r"(?s:-----BEGIN (?:RSA |EC |DSA |OPENSSH |PGP )?PRIVATE KEY-----.*?-----END (?:RSA |EC |DSA |OPENSSH |PGP )?PRIVATE KEY-----)",
    r"https://hooks\.slack\.com/services/T[A-Za-z0-9_]+/B[A-Za-z0-9_]+/[A-Za-z0-9_]+",
    r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
    r"(?:A3T[A-Z0-9]|AKIA|AGPA|AIDA|AROA|AIPA|ANPA|ANVA|ASIA)[A-Z0-9]{16}",
    r"github_pat_[A-Za-z0-9]{22}_[A-Za-z0-9]{59}",
    r"gh[oprsu]_[A-Za-z0-9]{36}",
    r"AIza[0-9A-Za-z_-]{35}",
    r"GOCSPX-[A-Za-z0-9_-]{20,40}",
    r"xox[baprs]-[A-Za-z0-9-]{10,48}",
    r"(?:sk|rk|pk)_(?:live|test)_[0-9A-Za-z]{16,99}",
    r"sk-[A-Za-z0-9_-]{20,}",
    r"pypi-[A-Za-z0-9_-]{16,}",
    r"(?i:bearer)\s+[A-Za-z0-9._~+/-]{16,}=*",
]
URL = [
    r"(?:https?|ftp)://[^\s/$.?#][^\s]*",
    r"www\.[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+(?:/[^\s]*)?",
]
EMAIL = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,24}"]
IBAN = [r"\b[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?\b"]
CARD = [r"\b[0-9](?:[ -]?[0-9]){12,18}\b"]
SSN = [r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b"]
PHONE = [
    r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-][0-9]{2,4}){1,4}",
    r"\([0-9]{3}\)[ .-]?[0-9]{3}[ .-]?[0-9]{4}",
    r"\b[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}\b",
]
MONTH = r"(?i:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
DATE = [
    r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b",
    r"\b[0-9]{1,2}[/.][0-9]{1,2}[/.][0-9]{2,4}\b",
    r"\b" + MONTH + r"\b\.?\s+[0-9]{1,2}(?:st|nd|rd|th)?(?:,?\s+[0-9]{2,4})?",
    r"\b[0-9]{1,2}(?:st|nd|rd|th)?\s+" + MONTH + r"\b(?:,?\s+[0-9]{2,4})?",
]

#: (category, its patterns); digits of the fifth must also pass the Luhn check.
GROUPS = [
    ("secret", SECRET), ("private_url", URL), ("private_email", EMAIL), ("account_number", IBAN),
    ("account_number", CARD), ("account_number", SSN), ("private_phone", PHONE), ("private_date", DATE),
]
LUHN_GROUP = 5

#: All of them, as the definition has it; for engines that need no backtracking.
PLAIN = "|".join("(" + "|".join(patterns) + ")" for _, patterns in GROUPS)


def _bounded(pattern: str) -> str:
    """The same matches from an engine that backtracks, in linear time and without deep recursion.

    An address that fails from the beginning of a run of its characters fails from anywhere within it, so others need
    not be tried unless the scan itself begins there. Labels of a host can't be matched in another way.
    """
    if pattern in EMAIL:
        return r"(?:\G|(?<![A-Za-z0-9._%+-]))" + pattern.replace("+@", "++@", 1)
    return pattern.replace(r"(?:\.[A-Za-z0-9-]+)+(", r"(?:\.[A-Za-z0-9-]++)++(")


#: The same for Java, where white space, word characters and case follow Unicode.
COMBINED = "(?U)" + "|".join("(" + "|".join(map(_bounded, patterns)) + ")" for _, patterns in GROUPS)

#: Any text with a match holds one of these, or a digit, or ``bearer`` in any case. Plain searches are several times
#: quicker than the scan, and few texts need it.
TRIGGERS = [
    "@", "://", "www.", "-----BEGIN", "eyJ", "GOCSPX-", "AIza", "xoxb-", "xoxa-", "xoxp-", "xoxr-", "xoxs-", "_live_", "_test_", "sk-", "pypi-",
    "gho_", "ghp_", "ghr_", "ghs_", "ghu_", "github_pat_", "A3T", "AKIA", "AGPA", "AIDA", "AROA", "AIPA", "ANPA", "ANVA", "ASIA",
]
