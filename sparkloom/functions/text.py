"""Text functions as column expressions; none needs Python at run time.

Java's \\s and \\w are ASCII unless (?U) says otherwise; where only ASCII is meant the
character classes are spelled out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII white space.
SPACE = r"[ \t\n\x0B\f\r]"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"

#: Contractions and what they stand for, replaced in this order.
CONTRACTIONS = {
    "don't": "do not", "didn't": "did not", "doesn't": "does not", "won't": "will not", "can't": "cannot",
    "couldn't": "could not", "shouldn't": "should not", "wouldn't": "would not", "aren't": "are not",
    "isn't": "is not", "wasn't": "was not", "weren't": "were not", "haven't": "have not", "hasn't": "has not",
    "hadn't": "had not", "mustn't": "must not", "mightn't": "might not", "needn't": "need not",
    "shan't": "shall not", "i'm": "i am", "you're": "you are", "we're": "we are", "they're": "they are",
    "he's": "he is", "she's": "she is", "it's": "it is", "i've": "i have", "you've": "you have",
    "we've": "we have", "they've": "they have", "i'll": "i will", "you'll": "you will", "he'll": "he will",
    "she'll": "she will", "we'll": "we will", "they'll": "they will", "i'd": "i would", "you'd": "you would",
    "he'd": "he would", "she'd": "she would", "we'd": "we would", "they'd": "they would", "let's": "let us",
    "that's": "that is", "there's": "there is", "what's": "what is", "how's": "how is", "who's": "who is",
}

#: Labels of intents, and labels of entities in their order.
INTENTS = (
    "account_access", "attendance", "contact_information", "email_problems", "employee_id", "goodbye", "greetings",
    "help", "holidays", "hr_support", "internet_problems", "laptop_problems", "leave_policy", "office_location",
    "password_reset", "payroll", "salary_information", "security", "software_installation", "technical_support",
    "wifi_problems", "working_hours",
)
INTENT_ALIASES = {
    "laptop_problem": "laptop_problems", "laptop_issue": "laptop_problems", "email_problem": "email_problems",
    "wifi_problem": "wifi_problems", "internet_problem": "internet_problems",
    "software_install": "software_installation", "salary": "salary_information",
}
ENTITIES = (
    "email", "account", "password", "laptop", "wifi", "software", "leave", "salary", "payroll", "internet",
    "working_hours", "employee_id", "holiday", "attendance", "hr", "security", "contact", "location", "it_support",
    "greeting", "goodbye", "help",
)

#: English words without meaning of their own.
STOPWORDS = tuple(
    "i me my we our you your he him his she her it its they them their what which who this that these those am is "
    "are was were be been being have has had having do does did doing a an the and but if or because as until while "
    "of at by for with about against between into through during before after above below to from up down in out on "
    "off over under again further then once here there when where why how all any both each few more most other some "
    "such no nor not only own same so than too very can will just should now".split()
)
NEGATIONS = ("not", "no", "never")


def strip(text: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def is_blank(text: Column) -> Column:
    """Null, or nothing but white space."""
    return text.isNull() | (strip(text) == "")


def collapse(text: Column) -> Column:
    """Single spaces for white space, none at the ends."""
    return F.trim(F.regexp_replace(text, SPACE + "+", " "))


def release_year(title: Column) -> Column:
    """The year of a trailing (dddd), else null."""
    return F.nullif(F.regexp_extract(title, r"\((\d{4})\)\s*$", 1), F.lit("")).try_cast("int")


def strip_release_year(title: Column) -> Column:
    return strip(F.regexp_replace(title, r"\s*\(\d{4}\)\s*$", ""))


def normal_tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits of any script, hyphens inside kept."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+(?:-[\p{L}\p{N}]+)*"), 0)
    return F.coalesce(found, F.array().cast("array<string>"))


def normalize_text(text: Column) -> Column:
    return F.array_join(normal_tokens(text), " ")


def split_values(text: Column, sep: str = "|", none: str = "(none)") -> Column:
    """Parts of a delimited text, blanks dropped; the pseudo value when none is left."""
    parts = F.filter(F.split(F.coalesce(text, F.lit("")), f"[{sep}]"), lambda x: F.trim(x) != "")
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(F.lit(none)))


def clean_news_train(text: Column) -> Column:
    """Markup, links, addresses, punctuation, digits and non-ASCII each give way to a space."""
    out = F.lower(F.coalesce(text, F.lit("")))
    for pattern in (r"<[^>]+>", r"http[^ \t\n\x0B\f\r]+|www\.[^ \t\n\x0B\f\r]+",
                    r"[^ \t\n\x0B\f\r]+@[^ \t\n\x0B\f\r]+\.[^ \t\n\x0B\f\r]+", r"[!-/:-@\[-`{-~]", r"[0-9]+",
                    r"[^a-zA-Z \t\n\x0B\f\r]", r"[^\x00-\x7F]+"):
        out = F.regexp_replace(out, pattern, " ")
    return collapse(out)


def clean_news_serve(text: Column) -> Column:
    """Links, addresses and all but letters are deleted, and words of up to two letters.

    It is another cleaning than the one for training, on purpose.
    """
    out = F.lower(F.coalesce(text, F.lit("")))
    for pattern in (r"http[^ \t\n\x0B\f\r]+|www[^ \t\n\x0B\f\r]+", r"[^ \t\n\x0B\f\r]+@[^ \t\n\x0B\f\r]+",
                    r"[^a-zA-Z \t\n\x0B\f\r]"):
        out = F.regexp_replace(out, pattern, "")
    return F.array_join(F.filter(F.split(collapse(out), " "), lambda w: F.length(w) > 2), " ")


def clean_helpdesk(text: Column) -> Column:
    """Lower case; control characters, closing question marks, all but a-z, 0-9, ' and - go."""
    out = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), CONTROL, "")
    out = F.regexp_replace(collapse(out), r"\?+ *$", "")
    out = F.regexp_replace(F.regexp_replace(out, r"!{2,}", "!"), r"\.{2,}", ".")
    return collapse(F.regexp_replace(out, r"[^a-z0-9 \t\n\x0B\f\r'-]", ""))


def typographic(text: Column) -> Column:
    """Curly quotes, dashes and hard spaces made plain; control characters dropped."""
    curly, plain = "\u2019\u2018\u201c\u201d\u2013\u2014\u00a0", "''\"\"-- "
    out = F.translate(F.coalesce(text, F.lit("")), curly, plain)
    return collapse(F.regexp_replace(out, CONTROL, ""))


def expand_contractions(text: Column) -> Column:
    """Replaced anywhere in the text, within words too."""
    for short, full in CONTRACTIONS.items():
        text = F.replace(text, F.lit(short), F.lit(full))
    return text


def tokenize(text: Column) -> Column:
    """Lower-cased ASCII tokens after contractions are expanded."""
    found = F.regexp_extract_all(expand_contractions(F.lower(text)), F.lit("[a-z0-9']+"), 0)
    bare = F.transform(found, lambda w: F.regexp_replace(w, "^'+|'+$", ""))
    return F.coalesce(F.filter(bare, lambda w: w.rlike("^[a-z0-9]+$")), F.array().cast("array<string>"))


def remove_stopwords(tokens: Column, keep: tuple[str, ...] = (), least: int = 1) -> Column:
    stop = F.array(*[F.lit(w) for w in STOPWORDS if w not in keep])
    return F.filter(tokens, lambda w: ~F.array_contains(stop, w) & (F.length(w) >= least))


#: Endings of English plurals, what takes their place, and the shortest word they are taken from; the first that fits counts.
LEMMA_ENDINGS = (
    ("(ss|us|is|ous)$", None, 1), ("(ch|sh|ss|x|zz)es$", "$1", 5), ("ies$", "y", 5), ("([^aeious])s$", "$1", 4), ("([aeo])s$", "$1", 4),
)


def lemma(word: Column) -> Column:
    """A lower-cased word without its plural ending, by LEMMA_ENDINGS; other words are their own lemma.

    There is no dictionary: irregular plurals and verb forms stay as they are.
    """
    out = None
    for ending, to, least in LEMMA_ENDINGS:
        fits = word.rlike(ending) & (F.length(word) >= least)
        value = word if to is None else F.regexp_replace(word, ending, to)
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out.otherwise(word)


def snake(label: Column) -> Column:
    """A label in lower snake case; null becomes empty."""
    out = F.lower(strip(F.coalesce(label, F.lit(""))))
    for pattern, to in ((SPACE + "+", "_"), (r"[^a-z0-9_]", ""), (r"_+", "_"), (r"^_+|_+$", "")):
        out = F.regexp_replace(out, pattern, to)
    return out


def normalize_intent(label: Column) -> Column:
    """Snake case, then the canonical name of known aliases."""
    out = snake(label)
    for alias, name in INTENT_ALIASES.items():
        out = F.when(out == alias, F.lit(name)).otherwise(out)
    return out


def normalize_entity(label: Column, entities: tuple[str, ...] = ENTITIES) -> Column:
    """The canonical entity, else the first that the label continues with _, else itself."""
    value = snake(label)
    known = F.array(*[F.lit(e) for e in entities])
    starts = F.filter(known, lambda e: F.startswith(value, F.concat(e, F.lit("_"))))
    return F.when(F.array_contains(known, value), value).otherwise(F.coalesce(F.get(starts, F.lit(0)), value))


def extract_entities(text: Column, vocabulary: dict[str, tuple[str, ...]]) -> Column:
    """Entities of which a keyword stands in the text as whole words, in their order."""
    low = F.lower(F.coalesce(text, F.lit("")))
    found = [
        F.when(low.rlike(r"\b(?:" + "|".join(keywords) + r")\b"), F.lit(entity))
        for entity, keywords in vocabulary.items()
    ]
    return F.filter(F.array(*found), lambda e: e.isNotNull())


def ngrams(tokens: Column, n: int) -> Column:
    """Contiguous n-grams joined by spaces; none when there are too few tokens.

    tokens should be a plain column, since it is read again at every place.
    """
    if n == 1:
        return tokens
    from_ = F.sequence(F.lit(1), F.size(tokens) - (n - 1))
    grams = F.transform(from_, lambda i: F.array_join(F.slice(tokens, i, F.lit(n)), " "))
    return F.when(F.size(tokens) >= n, grams).otherwise(F.array().cast("array<string>"))


def parse_date(text: Column) -> Column:
    """"December 31, 2017" or "19-Feb-18" as a timestamp, else null.

    Two-digit years from 69 on are of the last century.
    """
    long = F.try_to_timestamp(text, F.lit("MMMM d, yyyy"))
    short = F.try_to_timestamp(text, F.lit("d-MMM-yy"))
    short = F.when(F.year(short) >= 2069, short - F.expr("interval 100 years")).otherwise(short)
    return F.coalesce(long, short)
