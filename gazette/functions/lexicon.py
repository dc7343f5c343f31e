"""Word lists of gazette's built-in rule annotator.

These lists belong to our own annotator (the tokens schema is the contract;
any statistical annotator can be plugged in instead). Closed word classes are
written out; inflected verb forms are generated from base forms by rule.
All entries are lower case.
"""

from __future__ import annotations

# --- closed classes -------------------------------------------------------
PRONOUNS = (
    "i me my mine myself you your yours yourself yourselves he him his himself "
    "she her hers herself it its itself we us our ours ourselves they them "
    "their theirs themselves"
).split()

DETERMINERS = (
    "the a an this that these those each every some any no another all both "
    "either neither such what which whose"
).split()

ADPOSITIONS = (
    "of in on at by for with from into onto over under about after before "
    "between through during without within against among across behind beyond "
    "near upon via per than off up down out around along despite toward towards"
).split()

CONJUNCTIONS = "and or but nor plus".split()

SUBORDINATORS = (
    "because although though while whereas if unless whether as once until "
    "whenever wherever"
).split()

AUXILIARIES = (
    "be am is are was were been being have has had having do does did will "
    "would shall should can could may might must"
).split()

PARTICLES = "to not n't".split()

INTERJECTIONS = "yes oh wow hey hello ok okay ah alas oops hmm".split()

ADVERBS = (
    "however also very now then just still even only already again ever never "
    "always often here there too quite rather soon almost instead meanwhile "
    "moreover furthermore therefore thus indeed perhaps maybe today tomorrow "
    "yesterday later so how why where when well far yet"
).split()

NUMBER_WORDS = (
    "zero one two three four five six seven eight nine ten eleven twelve "
    "twenty thirty forty fifty hundred thousand million billion trillion"
).split()

QUOTES = ['"', "'", "“", "”", "‘", "’", "«", "»",
          "`", "„", "‹", "›"]

# --- verbs: base forms; regular inflections come from ``verb_forms`` ------
VERB_BASES = (
    "say tell grow make take get go come see know think look want give use find "
    "work call try ask need feel become leave put mean keep let begin seem help "
    "show hear play run move live believe bring happen write provide sit stand "
    "lose pay meet include continue set learn change lead understand watch "
    "follow stop create speak read allow add spend open walk win offer remember "
    "love consider appear buy wait serve die send expect build stay fall cut "
    "reach kill remain suggest raise pass sell require report decide pull "
    "launch announce release reveal unveil plan hit rise warn claim confirm "
    "deny acquire invest hire fire sue ban block fix update cost close agree "
    "start end join fail face hold post share"
).split()

# Irregular forms (form -> base). Regular ones are produced by rule.
IRREGULAR_VERBS = {
    "said": "say", "told": "tell", "grew": "grow", "grown": "grow",
    "made": "make", "took": "take", "taken": "take", "got": "get",
    "gotten": "get", "went": "go", "gone": "go", "came": "come", "saw": "see",
    "seen": "see", "knew": "know", "known": "know", "thought": "think",
    "gave": "give", "given": "give", "found": "find", "felt": "feel",
    "became": "become", "left": "leave", "meant": "mean", "kept": "keep",
    "began": "begin", "begun": "begin", "brought": "bring", "wrote": "write",
    "written": "write", "sat": "sit", "stood": "stand", "lost": "lose",
    "paid": "pay", "met": "meet", "led": "lead", "understood": "understand",
    "spoke": "speak", "spoken": "speak", "spent": "spend", "won": "win",
    "bought": "buy", "sent": "send", "built": "build", "fell": "fall",
    "fallen": "fall", "held": "hold", "ran": "run", "rose": "rise",
    "risen": "rise", "sold": "sell", "shown": "show",
}

# Lemmas of non-verb forms and of auxiliaries.
OTHER_LEMMAS = {
    "am": "be", "is": "be", "are": "be", "was": "be", "were": "be",
    "been": "be", "being": "be", "has": "have", "had": "have",
    "having": "have", "does": "do", "did": "do", "done": "do",
    "best": "good", "better": "good", "worse": "bad", "worst": "bad",
    "n't": "not", "news": "news", "ca": "can", "wo": "will",
}

STOP_WORDS = sorted(set(
    PRONOUNS + DETERMINERS + ADPOSITIONS + CONJUNCTIONS + SUBORDINATORS
    + AUXILIARIES + PARTICLES + (
        "also very just still even only already again ever never always often "
        "here there too quite rather then now so how why where when who whom "
        "whose which what more most other others own same few many much several "
        "into onto whereas hence thereby therein whether yet"
    ).split()
))


def verb_forms(base: str) -> list[str]:
    """Regular inflections of a base verb: -s, -ed, -ing (spelling rules)."""
    vowels = "aeiou"
    if base.endswith(("s", "sh", "ch", "x", "z", "o")):
        third = base + "es"
    elif base.endswith("y") and len(base) > 1 and base[-2] not in vowels:
        third = base[:-1] + "ies"
    else:
        third = base + "s"
    if base.endswith("e"):
        past, ing = base + "d", base[:-1] + "ing"
    elif base.endswith("y") and len(base) > 1 and base[-2] not in vowels:
        past, ing = base[:-1] + "ied", base + "ing"
    else:
        past, ing = base + "ed", base + "ing"
    if base.endswith("ie"):
        ing = base[:-2] + "ying"
    return [base, third, past, ing]


def _build():
    lemma: dict[str, str] = {}
    pos: dict[str, str] = {}
    for b in VERB_BASES:
        for f in verb_forms(b):
            lemma.setdefault(f, b)
            pos.setdefault(f, "VERB")
    for f, b in IRREGULAR_VERBS.items():
        lemma[f] = b
        pos[f] = "VERB"
    # closed classes override verb guesses (e.g. "set" stays VERB, "can" AUX)
    for words, tag in ((DETERMINERS, "DET"), (ADPOSITIONS, "ADP"),
                       (CONJUNCTIONS, "CCONJ"), (SUBORDINATORS, "SCONJ"),
                       (AUXILIARIES, "AUX"), (PARTICLES, "PART"),
                       (INTERJECTIONS, "INTJ"), (ADVERBS, "ADV"),
                       (NUMBER_WORDS, "NUM"), (PRONOUNS, "PRON")):
        for w in words:
            pos[w] = tag
    pos["%"] = "NOUN"
    pos["`"] = "PUNCT"
    for f, b in OTHER_LEMMAS.items():
        lemma[f] = b
    for w in PRONOUNS:
        lemma[w] = "-PRON-"
    return lemma, pos


LEMMA_MAP, POS_MAP = _build()
