"""Predicates on text and the element type that they decide.

Sentence and verb tests need a tagger that isn't available; here they are rules, in Columns: a sentence ends at
``. ! ?`` and its CJK forms before white space or the end, and a text has a verb if it has a common one or a word
that ends as verbs do. The results are approximate where the reference's tagger decides, and only there.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as X

_STATES = (
    "Iowa Utah Ohio Maine Idaho Texas Nevada Alaska Hawaii Oregon Kansas Florida Georgia Alabama Indiana Montana Arizona Wyoming Vermont Virginia Nebraska "
    "Oklahoma Maryland Delaware Missouri New_York Michigan Colorado Arkansas Illinois Kentucky Louisiana Minnesota Tennessee Wisconsin California "
    "Washington New_Mexico New_Jersey Mississippi Connecticut Pennsylvania North_Dakota South_Dakota Rhode_Island West_Virginia New_Hampshire Massachusetts "
    "North_Carolina South_Carolina "
).split()
_CODES = "AK AL AR AS AZ CA CO CT DC DE FL FM GA GU HI IA ID IL IN KS KY LA MA MD ME MH MI MN MO MP MS MT NC ND NE NH NJ NM NV NY OH OK OR PA PR PW RI SC SD TN TX UT VA VI VT WA WI WV WY".split()
#: City, state or its code, five digits. Alabama and Wyoming count as well.
CITY_STATE_ZIP = r"(?i)^\b(?:[A-Z][a-z.-]{1,15} ?){1,5},\s?(?:" + "|".join(x.replace("_", "[ ]") for x in sorted(_STATES, key=len, reverse=True) + _CODES) + r")(?:, |\s)?\b\d{5}(?:-\d{4})?\b"
_VERBS = (
    "am is are was were be been being do does did done have has had can could will would shall should may might must go goes went gone get gets got make makes made take takes took taken "
    "see sees saw seen say says said know knows knew known think thinks thought come comes came give gives gave given find finds found tell tells told become becomes became leave left feel felt "
    "put bring brought begin began begun keep kept hold held write writes wrote written stand stood hear heard let mean meant set meet met run runs ran pay paid sit sat speak spoke lie lay lead led read "
    "grow grew lose lost fall fell send sent build built understand draw drew break broke spend spent cut rise rose drive drove buy bought wear wore choose chose"
).split()
VERB = r"(?i)\b(?:" + "|".join(_VERBS) + r"|\p{L}{2,}(?:ing|ed|izes?|ises?|ifies|ify))\b"
SENTENCE_END = r"(?<=[.!?])[\"')\]”’]*\s+(?=[^\s])|(?<=[。！？])"
ZH_NOT_TITLE = r"[，。、；！|,;!]"
ZH_NOT_PPTX_TITLE = r"[。；！|;!]"
EMOJI = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{1F1E6}-\x{1F1FF}\x{2B50}\x{2B55}\x{231A}\x{231B}\x{23E9}-\x{23F3}]"


def sentences(t: Column) -> Column:
    return F.filter(F.split(t, SENTENCE_END), lambda s: s.rlike(r"(?U)\S"))


def words(t: Column) -> Column:
    """Runs of letters, digits and apostrophes; every CJK character is a word."""
    return F.regexp_extract_all(t, F.lit(r"[一-鿿぀-ヿ]|(?:(?![一-鿿぀-ヿ])[\p{L}\p{N}'])+"), F.lit(0))


def sentence_words(t: Column) -> Column:
    """The number of words of each sentence. Project it once where several predicates want it, and hand it to them as
    ``counts``."""
    return F.transform(sentences(t), lambda s: F.size(words(X.remove_punctuation(s))))


def sentence_count(t: Column, min_length: int | None = None, counts: Column | None = None) -> Column:
    if counts is None:
        counts = sentence_words(t) if min_length else sentences(t)
    return F.size(F.filter(counts, lambda n: n >= min_length)) if min_length else F.size(counts)


def contains_verb(t: Column) -> Column:
    return t.rlike(VERB)


def is_numeric(t: Column) -> Column:
    return t.rlike(r"^\p{N}+$")


def is_upper(t: Column) -> Column:
    return t.rlike(r"\p{Lu}") & ~t.rlike(r"\p{Ll}")


def alpha_ratio(t: Column) -> Column:
    """Letters to characters other than white space; null where there are none of these."""
    return F.length(F.regexp_replace(t, r"[^\p{L}]", "")) / F.nullif(F.length(F.regexp_replace(t, r"(?U)\s", "")), F.lit(0))


def under_non_alpha_ratio(t: Column, threshold: float = 0.5) -> Column:
    return F.coalesce(alpha_ratio(t) < threshold, F.lit(False))


def exceeds_cap_ratio(t: Column, threshold: float = 0.5, counts: Column | None = None) -> Column:
    alpha = F.filter(words(t), lambda w: w.rlike(r"^\p{L}+$"))
    caps = F.filter(alpha, lambda w: w.rlike(r"^\p{Lu}\P{Lu}*$|^\p{Lu}+$"))
    share = F.size(caps) / F.nullif(F.size(alpha), F.lit(0))
    return F.when(sentence_count(t, 3, counts) > 1, False).when(is_upper(t), True).otherwise(F.coalesce(share > threshold, F.lit(True)))


def is_possible_narrative_text(t: Column, cap_threshold: float = 0.5, non_alpha_threshold: float = 0.5, language: str = "en", counts: Column | None = None) -> Column:
    out = (F.length(t) > 0) & ~is_numeric(t) & ~exceeds_cap_ratio(t, cap_threshold, counts) & ~under_non_alpha_ratio(t, non_alpha_threshold)
    return out & ((sentence_count(t, 3, counts) >= 2) | contains_verb(t)) if language == "en" else out


def is_possible_title(t: Column, sentence_min_length: int = 5, title_max_word_length: int = 12, non_alpha_threshold: float = 0.5, language: str = "en", is_pptx: bool = False, counts: Column | None = None) -> Column:
    if language == "zh":
        return (F.length(t) > 0) & ~t.rlike(ZH_NOT_PPTX_TITLE if is_pptx else ZH_NOT_TITLE) & (F.length(t) <= title_max_word_length)
    return (
        (F.length(t) > 0)
        & ~(is_upper(t) & t.rlike(r"[^\w\s]\z"))
        & (F.size(F.split(t, " ")) <= title_max_word_length)
        & ~under_non_alpha_ratio(t, non_alpha_threshold)
        & ~t.endswith(",")
        & ~is_numeric(t)
        & (sentence_count(t, sentence_min_length, counts) <= 1)
    )


def is_bulleted_text(t: Column) -> Column:
    return X.strip(t).rlike(X.LEADING_BULLET)


def is_us_city_state_zip(t: Column) -> Column:
    bare = X.strip(t)  # what goes before the comma is looked at first, as the whole pattern tries all ways to cut it in words
    return bare.rlike(r"\A[A-Za-z][A-Za-z.\- ]{1,85},") & bare.rlike(CITY_STATE_ZIP)


def is_email_address(t: Column) -> Column:
    """Whether the text starts as an address in lower case does."""
    return X.strip(t).rlike("^" + X.EMAIL)


def contains_emoji(t: Column) -> Column:
    return t.rlike(EMOJI)


def contains_english_word(t: Column, vocabulary: list[str]) -> Column:
    """Whether any word of two letters or more is in the list; for long lists use ``operators.elements.word_list_semi_join``."""
    known = F.array(*[F.lit(w.lower()) for w in vocabulary]) if vocabulary else F.array().cast("array<string>")
    return F.arrays_overlap(F.filter(words(F.lower(t)), lambda w: F.length(w) > 1), known)


def has_embedded_image(t: Column) -> Column:
    return t.rlike(r"\[image: [^\]]+\]")


def embedded_image(t: Column) -> Column:
    """What the first ``[image: ...]`` holds; null where there is none."""
    return F.nullif(F.regexp_extract(t, r"\[image: ([^\]]+)\]", 1), F.lit(""))


def is_valid_date_arg(t: Column) -> Column:
    formats = ("yyyy-MM-dd", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd HH:mm:ss")
    return F.coalesce(*[F.try_to_timestamp(t, F.lit(f)) for f in formats]).isNotNull()


def is_chinese(c: Column) -> Column:
    return c.rlike(r"^[一-鿿]$")


def is_english_word(c: Column) -> Column:
    return c.rlike(r"^[A-Za-z0-9'\-]+$")


def is_valid_box(x0: Column, y0: Column, x1: Column, y1: Column, min_height: float = 8, min_width: float = 2) -> Column:
    return (x1 - x0 >= min_width) & (y1 - y0 >= min_height)


def segments_align(a0: Column, a1: Column, b0: Column, b1: Column, delta: float = 5, mode: int = 0) -> Column:
    """Whether b starts within a and either end of b lies by that of a (or, in mode 1, the middles are close)."""
    edge = (b0 - a0 <= delta) | (a1 - b1 <= delta)
    if mode == 1:
        edge = edge | (F.abs((a0 + a1) / 2 - (b0 + b1) / 2) <= delta)
    return segment_contains(a0, a1, b0, b1) & edge


def segment_contains(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Whether segment a holds the start of b."""
    return (a0 <= b0) & (b0 <= a1)


def segments_overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(a0, b0) < F.least(a1, b1)


def element_type(t: Column, language: str = "en", counts: Column | None = None) -> Column:
    """The type of a paragraph: list item, address of mail or place, narrative, title, else uncategorised."""
    return (
        F.when(is_bulleted_text(t), "ListItem")
        .when(is_email_address(t), "EmailAddress")
        .when(is_us_city_state_zip(t), "Address")
        .when(is_possible_narrative_text(t, language=language, counts=counts), "NarrativeText")
        .when(is_possible_title(t, language=language, counts=counts), "Title")
        .otherwise("UncategorizedText")
    )


def element_text(t: Column) -> Column:
    """The text that goes with ``element_type``: without its bullet for a list item."""
    return F.when(is_bulleted_text(t), X.clean_bullets(X.strip(t))).otherwise(t)


def html_element_type(t: Column, language: str = "zh") -> Column:
    """The type of a text in HTML; null where none is made of it."""
    bare = X.clean_bullets(X.strip(t))
    return (
        F.when(is_bulleted_text(t), F.when(bare != "", "ListItem"))
        .when(is_us_city_state_zip(t), "Address")
        .when(is_email_address(t), "EmailAddress")
        .when(F.length(t) < 2, F.lit(None))
        .when(is_possible_narrative_text(t), "NarrativeText")
        .when(is_possible_title(t, language=language), "Title")
        .otherwise("UncategorizedText")
    )
