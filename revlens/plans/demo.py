"""Word lists that occur in the given tables, whose texts are invented words in four languages."""

from __future__ import annotations

ASPECTS: dict[str, list[str]] = {
    "Technical Competence": ["rewh", "orre", "inoran"],
    "Multimedia Competence": ["ononst", "hehely"],
    "Localization Culture": ["der", "und", "sich"],
    "Domain Sensitivity": ["los", "del", "pour"],
    "Infrastructure & Filtering": ["des", "que"],
    "Transparency Eng": ["orantion", "from", "are"],
    "Temporal Memory": ["is", "was"],
}
FIRST_MATCH: dict[str, list[str]] = {
    "Technical Competence": ["rewhor", "ononst"],
    "Localization Culture": ["zu der", "lich"],
    "Domain Sensitivity": ["eaux", "ción"],
    "Transparency Eng": ["from the", "ertion"],
}
POSITIVE = ["the", "this", "with", "le", "die", "el", "reed", "thes"]
NEGATIVE = ["of", "was", "que", "der", "y", "thon", "onsh"]
FILLER = ["the", "of", "and", "a", "to", "in", "is", "de", "la", "der", "die", "el", "le"]
FLAGS = {"en": ["thion", "er the", "wh"], "fr": ["eaux", "que"], "de": ["ich", "der"]}
CATEGORIES = {
    "Technical_Competence": {"en": ["erst", "tion"], "fa": ["eau", "que"]},
    "Psychological_Safety": {"en": ["was the", "hant"], "fa": ["ung", "los"]},
    "Temporal_Memory": {"en": ["on the", "ening"], "fa": ["lich", "ció"]},
}
TOPICS = [["the", "of", "and"], ["de", "la", "que", "el"], ["der", "die", "und", "zu"], ["le", "les", "et", "un"], ["y", "en", "los"]]
STOPWORDS = ["the", "of", "and", "that", "is", "was", "de", "la", "not", "no"]
NEGATIONS = ["that", "not", "no"]
