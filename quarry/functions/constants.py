"""Fixed values of the search domain: word lists, lookup tables, patterns, weights.

They are part of the semantics (changing one changes results), so they are stated plainly here
and nowhere else.
"""

from __future__ import annotations

# Alphabet and token patterns (Java regular expressions).
CYRILLIC = "Ѐ-ӿ"
LETTERS = f"a-z{CYRILLIC}"
TOKEN_PATTERN = f"[{LETTERS}0-9]+(?:[./,-][{LETTERS}0-9]+)*"
INDEX_TERM_PATTERN = f"[{LETTERS}0-9]+"
CORPUS_TERM_PATTERN = r"[\p{L}\p{N}]+"
NUMBER_PATTERN = rf"(\d+(?:[.,]\d+)?)\s*([{LETTERS}/%]+)?"

# Words that never become tokens.
STOPWORDS = [
    "и", "в", "во", "на", "с", "со", "по", "для", "из", "к", "у", "от", "до", "или", "при",
    "под", "над", "без", "the", "with", "and", "of",
]

# Measurement units.
UNITS = [
    "мг", "г", "кг", "мл", "л", "мм", "см", "м", "гб", "мб", "тб", "шт", "уп", "%", "мг/мл",
    "ме/мл", "мкг",
]

# Inflection endings, longest first.
SUFFIXES = [
    "иями", "ями", "ами", "ого", "ему", "ому", "ыми", "ими", "иях",
    "ах", "ях", "ов", "ев", "ей", "ый", "ий", "ой", "ая", "яя", "ое", "ее", "ые", "ие", "ым",
    "им", "ых", "их", "ую", "юю", "ам", "ям", "ом", "ем",
    "ы", "и", "а", "я", "е", "у", "ю", "о",
]

# Keyboard layouts, key by key.
LATIN_KEYS = "`qwertyuiop[]asdfghjkl;'zxcvbnm,./"
CYRILLIC_KEYS = "ёйцукенгшщзхъфывапролджэячсмитьбю."

# Seed synonyms, alias -> canonical.
SEED_SYNONYMS = {
    "смартбай": "smartbuy", "смартбуй": "smartbuy", "смарт-бей": "smartbuy",
    "смарт-буй": "smartbuy", "леново": "lenovo", "делл": "dell", "юсб": "usb",
    "флешка": "usb", "флэшка": "usb", "флеш": "usb", "накопитель": "usb", "flash": "usb",
    "флешнакопитель": "usb", "флеш-накопитель": "usb", "рабочая": "рабочий",
    "рабочие": "рабочий", "рабочий": "рабочий", "тетрадь": "тетрадь", "тетради": "тетрадь",
    "ноут": "ноутбук", "ноуты": "ноутбук", "лэптоп": "ноутбук", "ультрабук": "ноутбук",
    "телефон": "смартфон", "мобильник": "смартфон", "мобила": "смартфон",
    "ручка": "канцтовары", "канцелярия": "канцтовары", "канцелярские": "канцтовары",
    "канцелярский": "канцтовары", "шина": "шины", "покрышка": "шины", "резина": "шины",
    "таб": "таблетки", "табл": "таблетки", "таблетка": "таблетки", "амп": "ампула",
    "ампулы": "ампула", "ампу": "ампула", "конфета": "конфеты", "конфетами": "конфеты",
    "конфет": "конфеты",
}

# Seed synonym groups, canonical -> members.
SEED_GROUPS = {
    "usb": ["флешка", "флэшка", "накопитель", "flash", "usb"],
    "смартфон": ["телефон", "phone", "iphone", "смартфон"],
    "ноутбук": ["ноут", "laptop", "notebook", "ультрабук", "ноутбук"],
    "шины": ["шина", "покрышка", "tire", "tyre", "резина"],
    "таблетки": ["таб", "табл", "таблетка", "tablets", "таблетки"],
    "канцтовары": ["канцелярия", "канцелярские", "ручка", "office"],
    "конфеты": ["конфета", "конфетами", "конфет", "конфеты"],
    "рабочий": ["рабочая", "рабочие", "рабочий"],
}

# Brands known without a dictionary.
KNOWN_BRANDS = ["smartbuy", "lenovo", "dell"]

# Header cells by which a header row is recognised.
PRODUCT_HEADER = [
    "id сте", "идентификатор сте", "наименование сте", "категория", "атрибуты",
]
CONTRACT_HEADER = [
    "наименование закупки", "идентификатор контракта", "идентификатор сте",
    "дата заключения контракта", "стоимость контракта", "инн заказчика",
    "наименование заказчика", "регион заказчика", "инн поставщика",
    "наименование поставщика", "регион поставщика",
]
CATALOG_HEADER = {
    "id сте": "id", "название сте": "title", "ссылка на картинку сте": "image_url",
    "модель": "model", "страна происхождения": "country_origin",
    "производитель": "manufacturer", "id категории": "category_id",
    "название категории": "category_name", "характеристики": "attributes_raw",
}

# Bits of the term dictionary's source mask.
SOURCE_BITS = {
    "title": 1, "category": 2, "brand": 4, "model": 8, "attribute_name": 16,
    "attribute_value": 32, "purchase_name": 64, "seed": 128,
}

# Session event types and their weights.
EVENT_TYPES = [
    "search_submitted", "result_opened", "result_bounced", "result_saved",
    "marked_relevant", "marked_irrelevant",
]
EVENT_WEIGHTS = {
    "result_opened": 0.45, "result_saved": 1.1, "marked_relevant": 1.8,
    "marked_irrelevant": -4.5, "result_bounced": -2.8,
}

NEW_CUSTOMER = "__new_customer__"
NO_BRAND = "Без бренда"

# Vocabulary of the rule-based query facets.
CATEGORY_KEYWORDS = {
    "шина": ["шина", "шины", "tire", "tyre"],
    "ноутбук": ["ноутбук", "ноутбуки", "laptop", "notebook"],
    "смартфон": ["смартфон", "смартфоны", "phone", "iphone"],
    "монитор": ["монитор", "мониторы", "monitor", "display"],
    "клавиатура": ["клавиатура", "клавиатуры", "keyboard"],
    "мышь": ["мышь", "мышка", "мыши", "mouse"],
    "наушники": ["наушники", "headphones", "headset"],
    "планшет": ["планшет", "планшеты", "tablet"],
    "принтер": ["принтер", "принтеры", "printer"],
}
ATTRIBUTE_KEYWORDS = {
    "Тип": {
        "Бескамерная": ["бескамерная", "tubeless"],
        "Беспроводная": ["беспроводная", "wireless"],
        "Механическая": ["механическая", "mechanical"],
        "Лазерный": ["лазерный", "laser"],
    },
    "Цвет": {
        "Черный": ["черный", "черная", "black"],
        "Белый": ["белый", "белая", "white"],
        "Красный": ["красный", "красная", "red"],
    },
}
MATCH_SENTENCES = {
    "brand": "Совпадение по бренду",
    "model": "Совпадение по модели",
    "category": "Совпадение по категории",
    "attributes": "Совпадение по характеристике",
    "numeric": "Совпадение по числовому ограничению",
    "text": "Найдено по тексту запроса",
}
DEFAULT_MATCH_SENTENCE = "Найдено релевантное совпадение"

# Sentences that explain a search score factor.
SEARCH_REASONS = {
    "lexical": "Совпадение в полнотекстовом индексе",
    "title_phrase": "Точная фраза запроса найдена в названии",
    "token_overlap": "Совпавшие слова в названии: ",
    "category": "Категория совпала: ",
    "attributes": "Совпавшие характеристики: ",
    "numeric": "Совпало числовых ограничений: ",
    "history_product": "Заказчик уже покупал этот СТЕ",
    "history_category": "Заказчик часто покупает эту категорию",
    "history_tokens": "Профиль заказчика усилил термины: ",
    "session_product_up": "Положительный сигнал в сессии поднял этот товар",
    "session_product_down": "Негативный сигнал в сессии понизил этот товар",
    "session_category_up": "Положительный сигнал в сессии усилил категорию",
    "session_category_down": "Негативный сигнал в сессии ослабил категорию",
    "none": "Совпадение по поисковому индексу",
}
# Sentences that explain a feed score factor.
FEED_REASONS = {
    "history_product": "Заказчик уже закупал этот СТЕ, поэтому товар поднят в базовой подборке.",
    "history_category": "Категория входит в сильные предпочтения заказчика: ",
    "popular": "Товар часто встречается в закупках и подходит для стартовой витрины.",
    "exploration_new": (
        "В подборку добавлен близкий вариант из подходящей категории, "
        "чтобы не показывать только ранее купленные СТЕ."
    ),
    "exploration_known": (
        "Подборка слегка разнообразена, "
        "чтобы рядом с привычными СТЕ появлялись похожие варианты."
    ),
    "history_tokens": "Название и характеристики совпали с частыми терминами профиля: ",
    "session_product_up": "Текущая сессия уже дала положительный сигнал по этому товару.",
    "session_product_down": "Текущая сессия дала отрицательный сигнал по этому товару.",
    "session_category_up": "Действия в текущей сессии усилили эту категорию.",
    "session_category_down": "Действия в текущей сессии ослабили эту категорию.",
    "none": "Подборка сформирована по истории закупок и популярности товара.",
}
