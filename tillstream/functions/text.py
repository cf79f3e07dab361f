"""Clean-up of names, numbers and free text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# Last word of a store name -> city.
CITY_BY_SUFFIX = {
    "Казань": "Казань",
    "Челны": "Набережные Челны",
    "Чебоксары": "Чебоксары",
    "Нижнекамск": "Нижнекамск",
    "Зеленодольск": "Зеленодольск",
    "Бугульма": "Бугульма",
    "Заинск": "Заинск",
    "Курск": "Курск",
    "Москва": "Москва",
    "Новочебоксарск": "Чебоксары",
    "Куюки": "Казань",
    "Сокуры": "Казань",
    "Дербышки": "Казань",
    "Васильево": "Казань",
    "Габишево": "Казань",
}
DEFAULT_CITY = "Казань"
# Words that mark products outside the food analysis.
NON_FOOD_WORDS = ["Пакет", "Капучино", "Латте", "Чай", "Американо", "Какао", "Pulpy",
                  "Кола", "Вода", "Сок", "Морс", "Компот", "Раф"]
# Spellings of yes and no in location sheets.
YES_EXACT = ["da", "yes", "est", "yest", "est'", "1"]
YES_PART = ["да", "есть", "ест"]
NO_PART = ["нет", "net", "-", "0"]
TRUE_WORDS = ["true", "1", "yes", "y"]


def city_from_store(name: Column, suffixes: dict[str, str] | None = None,
                    two_word: tuple[str, str] = ("Челны", "Набережные Челны"),
                    default: str = DEFAULT_CITY) -> Column:
    """City named by the last word, else by the last two words, else the default."""
    words = F.split(F.trim(name), r"\s+")
    last = F.element_at(words, -1)
    last_two = F.array_join(F.slice(words, F.greatest(F.size(words) - 1, F.lit(1)), F.lit(2)), " ")
    table = F.create_map(*[F.lit(x) for kv in (suffixes or CITY_BY_SUFFIX).items() for x in kv])
    by_pair = F.when((F.size(words) >= 2) & last_two.contains(two_word[0]), F.lit(two_word[1]))
    return F.coalesce(F.try_element_at(table, last), by_pair, F.lit(default))


def normalise_store(name: Column) -> Column:
    """Drop a trailing ` (n)` and a trailing number."""
    no_copy = F.regexp_replace(F.trim(name), r"\s*\(\d+\)\s*$", "")
    return F.trim(F.regexp_replace(no_copy, r"\s+\d+\s*$", ""))


def has_any_word(name: Column, words: Sequence[str]) -> Column:
    """True where `name` contains one of `words`, ignoring case; null counts as no match."""
    return F.coalesce(name.rlike("(?i)(?u)" + "|".join(f"\\Q{w}\\E" for w in words)), F.lit(False))


def category_by_keyword(name: Column, rules: Sequence[tuple[str, str]], default: str = "other") -> Column:
    """First rule whose keyword occurs in the lower-cased name."""
    low, out = F.lower(name), F
    for word, category in rules:
        out = out.when(low.contains(word.lower()), category)
    return out.otherwise(default)


def parse_number(text: Column) -> Column:
    """`1 234,50 р.` -> 1234.5; text that is no number becomes null."""
    digits = F.regexp_replace(F.regexp_replace(text, r"[^0-9,.\-]", ""), ",", ".")
    return F.regexp_replace(digits, r"\.+$", "").try_cast("double")


def parse_yes_no(text: Column) -> Column:
    """1, 0 or null for messy yes/no cells."""
    s = F.lower(F.trim(text))
    number = s.try_cast("double")

    def any_part(parts):
        cond = s.contains(parts[0])
        for p in parts[1:]:
            cond = cond | s.contains(p)
        return cond

    return (F.when(s.isNull(), None)
             .when(s.isin(YES_EXACT) | any_part(YES_PART), 1)
             .when(any_part(NO_PART), 0)
             .when(number.isNotNull(), (number > 0).cast("int")))


def parse_premise(text: Column) -> Column:
    """0 street, 1 street inside a mall, 2 mall."""
    s = F.lower(F.trim(text))
    mall = s.contains("тц") | s.contains("tc")
    street = s.contains("стрит") | s.contains("strit")
    return F.when(s.isNull(), None).when(mall & street, 1).when(mall, 2).otherwise(0)


def parse_flag(text: Column) -> Column:
    return F.coalesce(F.lower(F.trim(text.cast("string"))).isin(TRUE_WORDS), F.lit(False))


def safe_label(text: Column) -> Column:
    """Replace characters that are not allowed in file names."""
    return F.translate(F.trim(text), '/\\:*?"<>|', "_" * 9)
