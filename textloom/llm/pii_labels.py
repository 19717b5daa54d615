"""Labelled spans of real texts to train the recognizer of personal data on: structure, words that announce a kind in any text, and lists of names.

Only training uses this module. What may be personal data but can't be told by these means is ``doubtful``: training leaves it out
instead of taking it for something else. Contexts beyond these come from the invented sentences of ``pii_synth``.
"""

from __future__ import annotations

import regex

KINDS = ("email", "phone", "id_number", "address", "name")

#: Cues, by what they announce; those that follow a span are marked so.
D = r"\p{Nd}"
LOCAL, PART = r"(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._+-]*", r"[A-Za-z0-9][A-Za-z0-9-]*"
DOT = r"(?:[.．]|\s?(?:\(dot\)|\[dot\]|\{dot\})\s?|\s(?:dot|DOT)\s)"
EMAIL = regex.compile(rf"{LOCAL}(?:\s?(?:[@＠]|\(at\)|\[at\]|\{{at\}}|<at>)\s?{PART}(?:{DOT}[A-Za-z][A-Za-z0-9-]*)+|\s(?:at|AT)\s{PART}(?:\s(?:dot|DOT)\s[A-Za-z][A-Za-z0-9-]*)+)")
NUMBER = rf"(?:\+\s?)?[(]?{D}(?:[ .()\-]{{0,2}}{D}){{6,14}}"
BEFORE_PHONE = r"(?i:phone|whatsapp|phone/whatsapp|mobile|tel\.?|call|ring|the number is)|मोबाइल|फ़ोन|फोन|মোবাইল|ফোন|কল করুন|தொலைபேசி|கைபேசி"
AFTER_PHONE = r"পর?\s?কল|নম্বরে|पर कॉल|मा सम्पर्क|எண்ணில்"
PHONE = (
    regex.compile(rf"(?:{BEFORE_PHONE})\s*[:：]?\s*(?P<x>{NUMBER})(?!{D})"),
    regex.compile(rf"(?<![\p{{Nd}}/\-.])(?P<x>{NUMBER})(?=\s+(?:{AFTER_PHONE}))"),
    regex.compile(rf"(?<![\w])(?P<x>\+\s?{D}{{1,3}}[ -]?[(]?{D}(?:[ .()\-]{{0,2}}{D}){{6,11}})(?!{D})"),
    regex.compile(rf"(?m)^(?=(?:[^\p{{Nd}}\n]*{D}){{10,12}}[^\p{{Nd}}\n]*$)(?P<x>[(]?{D}{{3,5}}[)]?[ .-]?{D}{{3,5}}(?:[ .-]?{D}{{3,4}})?)$"),
)
PHONE += (regex.compile(rf"(?:(?m:^)|(?<=[.?!।] ))(?=(?:[^\p{{Nd}}\p{{L}}\n]*{D}){{10,12}}\s\p{{L}})(?P<x>[(]?{D}{{3,5}}[)]?[ .-]{D}{{3,5}}(?:[ .-]{D}{{3,4}})?|{D}{{2}}-{D}{{10}})(?!{D})"),)
ID_CUE = (
    r"(?i:passport(?: no\.?| number)?|national id|id number|id no\.?|voter card|citizenship certificate|driving licen[cs]e|aadhaar|nid)|পাসপোর্ট নম্বর|পাসপোর্ট|পরিচয়পত্র নং|এনআইডি|ভোটার কার্ড"
    r"|राहदानी नम्बर|राहदानी|मतदाता कार्ड|परिचयपत्र|नागरिकता(?: प्रमाणपत्र)?(?: नं\.?| नम्बर)?|पहचान संख्या|पासपोर्ट(?: संख्या| नंबर| नं\.?)?|आधार(?: संख्या)?|கடவுச்சீட்டு எண்|வாக்காளர் அட்டை|அடையாள எண்"
)
ID_CODE = rf"[A-Z]{{0,3}}[ -]?{D}(?:[ -]?{D}){{5,18}}"
ID_NUMBER = (
    regex.compile(rf"(?:{ID_CUE})\s*[:：]?\s*(?P<x>{ID_CODE})"),
    regex.compile(rf"(?<![\w-])(?P<x>{D}{{2}}-{D}{{2}}-{D}{{2}}-{D}{{5}})(?![\w-])"),
    regex.compile(r"(?<![\w/+=])(?P<x>[A-Z]{1,3}[0-9]{7})(?![\w/+=])"),
)
PLACE = r"[\p{L}\p{M}]+"
N = rf"{D}{{1,4}}[A-Za-z]?(?:/{D}{{1,3}})?"
ZIP = rf"(?:\s?-\s?|\s){D}{{4,6}}"
WAY = r"Road|Street|Lane|Avenue|লেন|সড়ক|রোড|সরণি|মার্গ|मार्ग|नगर|गली|सड़क|தெரு|நகர்|சாலை|வீதி"
ADDRESS = (
    regex.compile(rf"(?P<x>(?:(?:House|Flat|Plot|No\.?|বাড়ি|বাসা|ফ্ল্যাট|फ्लैट|मकान|घर नं\.?|घर|வீடு|எண்)\s?(?:নং\s)?)?(?:{N},\s)?{N},?\s(?:[\p{{L}}\p{{M}}]+\s(?:Tower|House|Court|टावर|টাওয়ার),\s)?{PLACE}(?:\s{PLACE})?\s(?:{WAY})(?:,\s?{PLACE}(?:\s{PLACE})?)?(?:{ZIP})?)(?![\p{{L}}\p{{M}}])"),
    regex.compile(rf"(?P<x>{PLACE}\sटोल,\sघर(?:\sनं\.?)?\s{N}(?:,\s?{PLACE})?(?:{ZIP})?)(?![\p{{L}}\p{{M}}])"),
    regex.compile(rf"(?P<x>(?:[Nn]o\.\s?){N},\s{PLACE}\s(?:Road|Street|Lane|Avenue)(?:,\s?{PLACE})?(?:{ZIP})?)(?![\p{{L}}\p{{M}}])"),
    regex.compile(rf"(?P<x>(?:House|Flat|Plot|No\.?|বাড়ি|বাসা|প্লট|ফ্ল্যাট|फ्लैट|प्लॉट|मकान|घर नं\.?|घर|வீடு|எண்)\s?(?:नं\.?|নং|no\.?)?\s?{N},\s(?:(?:Road|Street|Lane|Sector|সড়ক|সেক্টর|রোড|गली|सेक्टर|वडा|सड़क|தெரு|பகுதி)\s{D}{{1,3}}|[\p{{L}}\p{{M}}]+\s(?:Tower|House|Court))(?:,\s?{PLACE}(?:\s{PLACE})?)*(?:{ZIP})?)(?![\p{{L}}\p{{M}}])"),
)
LATIN_NAME = r"[A-Z][a-z]+(?: [A-Z]\.)? [A-Z][a-z]+"
INDIC_WORD = r"(?:(?:\p{Bengali}|\p{Devanagari}|\p{Tamil})(?<![।॥\p{Nd}]))+"
INDIC_NAME = rf"{INDIC_WORD}(?: {INDIC_WORD}\.)? {INDIC_WORD}"
NAME = (
    regex.compile(rf"(?:Dr\.?|Mr\.?|Mrs\.?|Ms\.?|My name is|signed by|written by|Regards,|Contact:)\s+(?P<x>{LATIN_NAME})"),
    regex.compile(rf"(?:জনাব|ডাঃ|ডা\.|বেগম|আমার নাম|লেখক:|যোগাযোগ:|श्री|श्रीमती|डॉ\.|डा\.|मेरा नाम|मेरो नाम|लेखक:|संपर्क:|सम्पर्क:|திரு|திருமதி|டாக்டர்|என் பெயர்|எழுதியவர்:|தொடர்புக்கு:|தொடர்பு:)\s+(?P<x>{INDIC_NAME})"),
)
#: What may be a name that the lists don't hold: capitals in a row, or a word before a verb of saying.
DOUBTFUL = regex.compile(r"[A-Z][a-z]+(?: [A-Z]\.)? [A-Z][a-z]+|[\p{Bengali}\p{Devanagari}\p{Tamil}]+ (?:বললেন|জানালেন|ने कहा|ने बताया|ले भने|ले भन्नुभयो|கூறினார்|என்றார்|சொன்னார்|வந்தார்)")


def doubtful(text: str, known: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(start, end) of what may be a name and isn't labelled."""
    return [m.span() for m in DOUBTFUL.finditer(text) if not any(a < m.end() and m.start() < b for a, b, _ in known)]


def spans(text: str, given: set[str], family: set[str]) -> list[tuple[int, int, int]]:
    """(start, end, kind) of labelled personal data; spans don't overlap, and the first kind that claims a place has it."""
    found: list[tuple[int, int, int]] = []

    def claim(start: int, end: int, kind: int) -> None:
        if end > start and all(end <= a or start >= b for a, b, _ in found):
            found.append((start, end, kind))

    for m in EMAIL.finditer(text):
        claim(*m.span(), 0)
    for pattern in ID_NUMBER:
        for m in pattern.finditer(text):
            claim(*m.span("x"), 2)
    for pattern in ADDRESS:
        for m in pattern.finditer(text):
            claim(*m.span("x"), 3)
    for pattern in PHONE:
        for m in pattern.finditer(text):
            claim(*m.span("x"), 1)
    for pattern in NAME:
        for m in pattern.finditer(text):
            claim(*m.span("x"), 4)
    words = [(m.start(), m.end(), m[0]) for m in regex.finditer(r"[\p{L}\p{M}]+", text)]
    for (a, b, one), (c, d, two) in zip(words, words[1:]):
        if one in given and two in family and text[b:c] == " ":
            claim(a, d, 4)
    return sorted(found)
