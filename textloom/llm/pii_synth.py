"""Invented sentences with labelled personal data, in varied contexts and formats, to train the recognizer on beside real texts.

Only training and its evaluation use this module. Every slot of a sentence is filled at random: names from lists, from syllables or from the letter
statistics of known names, numbers and addresses in the formats of many countries. Sentences are parted by their own text: one in ``HELD`` is never trained on,
so that recall can be told on contexts that the network has not met. Slots in lower case are personal data; those in upper case look like it and are none.
"""

from __future__ import annotations

import random
import zlib

import regex

from .pii import KINDS

HELD = 5
SLOT = regex.compile(r"\{(\w+)\}")
#: Names of persons of many countries, words and places to make addresses and organisations of.
GIVEN = (
    "Maria John Fatima Ahmed Wei Anna Peter Sofia Liam Olivia Noah Emma Carlos Lucia Hans Greta Ivan Olga Yuki Kenji Chen Ravi Priya Arjun Meera Kofi Ama Chidi Ngozi Tariq Leila Omar Zainab Pierre Camille Marco Giulia Lars "
    "Ingrid Mikko Aino Jan Eva Pavel Katya Thomas Sarah James Linda Robert Helen David Ruth Michael Karen Paul Nina George Alice Edward Rosa Frank Clara Henry Irene Walter Doris Diego Elena Mateo Valeria Minh Linh Siti Budi "
    "Aisha Yusuf Samuel Grace Daniel Esther Joseph Naomi Patrick Bridget Sean Aoife Owen Megan Rhys Callum Isla Anil Sunita Rajesh Kavita Deepak Lakshmi Mohan Sita Hari Gita Bikash Sabina Nusrat Rahim Karim Jamila Lal Zodin"
).split()
FAMILY = (
    "Smith Lopez Garcia Nguyen Khan Chen Wang Kim Park Tanaka Suzuki Sato Patel Sharma Singh Gupta Das Roy Ghosh Mukherjee Rahman Hossain Chowdhury Thapa Gurung Shrestha Karki Rao Reddy Iyer Menon Pillai Fernando Silva Santos Costa "
    "Pereira Rossi Ferrari Bianchi Müller Schmidt Weber Fischer Dubois Moreau Laurent Jansen Visser Hansen Nilsson Larsen Korhonen Novak Kowalski Horvath Popescu Ivanov Petrov Brown Johnson Williams Jones Taylor Davies Evans Walker "
    "Wright Hughes Green Hall Wood Clarke Baker Turner Cooper Hill Ward Morris King Allen Young Scott Murphy Kelly Byrne O'Brien Campbell Stewart MacDonald Okafor Mensah Adeyemi Diallo Haddad Hosseini Yilmaz Demir Cohen Levi Ralte Sailo Pachuau"
).split()
WORDS = (
    "river market garden silver meadow orchard station church castle bridge forest harbour valley summer winter copper stone timber lantern kettle basket saddle marble willow maple cedar falcon raven badger heron falls spring "
    "county central royal northern southern eastern western upper lower great little old new black white green red golden sunny quiet modern national general public district weekly daily annual early final open common"
).split()
WAYS = "Road Street Lane Avenue Drive Close Way Court Terrace Boulevard Crescent Place Square Row Gardens Parade Walk Grove".split()
CITIES = (
    "Leeds York Delhi Mumbai Kolkata Chennai Dhaka Kathmandu Pokhara London Dublin Boston Austin Denver Toronto Sydney Perth Nairobi Lagos Accra Cairo Paris Lyon Berlin Munich Madrid Seville Rome Milan Oslo Lima Quito Osaka Seoul "
    "Aizawl Guwahati Pune Jaipur Patna Sylhet Madurai Bristol Oxford Portland Springfield Riverside Franklin Salem Georgetown Clinton"
).split()
MONTHS = "January February March April May June July August September October November December".split()
DIGITS = {"hi": 0x966, "ne": 0x966, "bn": 0x9E6, "ta": 0xBE6}
#: Forms of numbers; # is any digit, 2 one that isn't 0 or 1, A a capital.
PHONES = (
    "###-###-####|(###) ###-####|###.###.####|+1 ### ### ####|+1-###-###-####|1-800-###-####|+44 20 #### ####|+44 7### ######|020 #### ####|07### ######|01### ######|+49 30 ######|+49 ### #######|+33 1 ## ## ## ##|06 ## ## ## ##"
    "|+91 ##### #####|+91-##########|+91##########|0## #### ####|#####-#####|##### #####|+880 1###-######|01###-######|+977 98########|98########|9#########|2#########|+86 ### #### ####|+81 3 #### ####|03-####-####|+55 11 #####-####|(0##) ####-####|(02#) #### ####"
    "|###-####|### ### ###|+61 4## ### ###|04## ### ###|91-##########|+234 80# ### ####|(###)###-####|+880-1###-######|+977-98########|+977 97### #####|+91 #### ### ###"
).split("|")
IDS = "A#######|AA#######|AAA#######|#### #### ####|####-####-####|############|###-##-####|##########|#############|#################|##-##-##-#####|AA######|A########|AA ## ## ## A|##### ##### ##|AA-##############|A## ######|#########|######-####|### ### ###".split("|")
ORDERS = "########|###########|A-######|##/####|####-####|978-#-###-#####-#|978-0-###-###-##|AA-####-###|#,###,###|######|##########|#############|#### ####|##.##.###.#|###-##|##############".split("|")
#: Sentences by language.
EN = """Yesterday {name} told us that the shop would close.
Send the invoice to {email} before {MONTH}.
According to {name}, the roof had leaked for weeks.
If you have questions, call {phone} during office hours.
Her passport number is {id}, issued in {CITY}.
She has lived at {address} since {YEAR}.
I saw {name} and {name} at the station.
{name} wrote the first chapter.
{name} and her brother run the bakery.
The winner, {name}, thanked the crowd.
Please contact {email} or {fphone}.
Reply to {email}; copies go to {email}.
Our new teacher is called {name}.
My husband {name} works at the bank in {CITY}.
Deliver everything to {address}, please.
The meeting takes place at {address} on {DATE}.
His social security number, {id}, should stay private.
Driver's license {id} was found on the floor.
Text me on {phone} when you arrive.
Phone: {phone}
Mobile {phone}, ask for {name}
Fax {phone}, phone {phone}
E-mail: {email}
Name: {name}
Address: {address}
ID card no. {id}
Passport: {id}
contact {email}
write to {email} for a copy
Sincerely, {name}
Best wishes, {name}, {address}
Thanks, {name}
Yours, {name}
Dr. {name} examined the patient.
Mr {name} lost his umbrella.
A letter from {name} arrived in {MONTH}.
Tickets are sold by {name} ({fphone}).
{name} <{email}> wrote:
From: {name} <{email}>
The tenant of {address} has paid.
A parcel for {name} waits at {address}.
Nobody has seen {name} since {MONTH}.
It was {name} who found the key.
We asked {name} for help, but the answer came from {email}.
I was born in {CITY}; my aadhaar number is {id}.
Voter id {id} belongs to {name}.
Citizenship card {id} was renewed in {YEAR}.
You will find the keys at {address}.
They used to rent a flat in {address}.
The national insurance number {id} was missing.
For bookings ring {phone} or mail {email}.
WhatsApp {phone} is quickest.
My new number is {phone}.
Dial {phone} and press two.
Tel: {phone} / {email}
Call me back on {fphone} tonight.
Customers complained to {email} about the delay.
Could you forward this to {email}?
The account of {name} was closed.
Photograph by {name}
Translated by {name} and edited by {name}.
Chairwoman {name} opened the session with a joke.
Professor {name} teaches history in {CITY}.
The house at {address} was sold.
Visit us at {address}!
Ship to: {name}, {address}
Tax id {id}, phone {phone}
identity card number {id} expired
I am {name} and I live in {CITY}.
My name is {name}.
Then {name} laughed and left the room.
The painter {name} died in {YEAR}.
his sister {name} stayed at home
{name}, aged 41, was not hurt.
{name} said nothing.
Interview with {name}
We thank {name} for the notes.
Her cousin, {name}, grew up at {address}.
Doctor {name} can be reached on {phone}.
The form lists {email} as the only contact.
Someone left a note: {fphone}, urgent.
Questions? {email}
Subscribe by sending a message to {email} today.
National ID: {id}, name: {name}
The ID number on the card reads {id}.
She showed her passport ({id}) at the gate.
The order number is {ORDER} and it was shipped on {DATE}.
Invoice {ORDER} is still open.
Ticket {ORDER} was closed by the team.
The book has the ISBN {ORDER}.
Account balance: {ORDER}
The bill no. {ORDER} is due in {MONTH}.
It sold {ORDER} copies in {YEAR}.
Flight {ORDER} to {CITY} was late.
The train to {CITY} leaves at 12:45 from track 12.
{ORG} was founded in {YEAR}.
He works for {ORG} in {CITY}.
They visited {PLACE} in {MONTH}.
{PLACE} is closed on {DATE}.
The road from {CITY} to {CITY} crosses {PLACE}.
{CITY} is larger than {CITY}.
{ORG} and {ORG} signed a contract.
The film {TITLE} was shown in {CITY}.
{TITLE} is a novel about the sea.
The score was 3-2 after 120 minutes.
Version 10.4.2.117 fixes the bug.
Open https://www.{WORD}.org/{WORD}/{ORDER} and follow @{WORD}_{WORD}.
Latitude 51.507222, longitude -0.127500.
Serial number {ORDER}, batch {ORDER}.
In {YEAR} there were {ORDER} people in {CITY}.
Meet us at 10 at {PLACE}.
There are 12 streets and 3 roads in the village.
The 25 Green Bottles song has {ORDER} verses.
Chapter 12, Section 3, page 144
Room 12 is free until {MONTH}.
Only {WORD} at heart can {WORD} at dot level.
The parcel with tracking code {ORDER} is lost.
Happy New Year from {ORG}!
On Monday Morning the {WORD} fair opens.
Library card for {ORG}: ask inside.""".split("\n")
OTHERS = {
    "hi": """मेरा ईमेल {email} है।
कृपया {phone} पर फ़ोन करें।
उनका पता {address} है।
कल {name} दिल्ली गए।
{name} और {name} बाज़ार में मिले।
पासपोर्ट नंबर {id} खो गया।
आधार संख्या {id} दर्ज है।
{name} ने कहा कि पानी नहीं है।
हम {address} में रहते हैं।
संपर्क: {name}, {phone}
पत्र {email} पर भेजें।
नाम: {name}
डॉ. {name} आज नहीं आएँगे।
हमारी शिक्षिका {name} हैं।
दुकान {address} पर है।
फ़ोन नंबर {phone} बदल गया है।
मतदाता पहचान पत्र {id} बनवाया।
बिल नंबर {ORDER} जमा करें।
ऑर्डर {ORDER} आ गया।
कीमत {ORDER} रुपये है।
तारीख {DATE} को मेला है।
{CITY} बड़ा शहर है।""".split("\n"),
    "bn": """আমার ইমেইল {email}।
{phone} নম্বরে ফোন করুন।
তাঁর ঠিকানা {address}।
গতকাল {name} ঢাকায় গেছেন।
{name} ও {name} বাজারে ছিলেন।
পাসপোর্ট নম্বর {id} হারিয়ে গেছে।
জাতীয় পরিচয়পত্র নম্বর {id}।
{name} জানালেন যে পানি নেই।
আমরা {address} এ থাকি।
যোগাযোগ: {name}, {phone}
চিঠি {email} এ পাঠান।
নাম: {name}
ডা. {name} আজ আসবেন না।
আমাদের শিক্ষক {name}।
দোকানটি {address} এ।
ফোন নম্বর {phone} বদলে গেছে।
ভোটার আইডি {id} নিয়ে আসুন।
চালান নম্বর {ORDER} জমা দিন।
অর্ডার {ORDER} এসেছে।
দাম {ORDER} টাকা।
তারিখ {DATE} মেলা হবে।
{CITY} বড় শহর।""".split("\n"),
    "ne": """मेरो इमेल {email} हो।
कृपया {phone} मा फोन गर्नुहोस्।
उहाँको ठेगाना {address} हो।
हिजो {name} काठमाडौं जानुभयो।
{name} र {name} बजारमा भेटिए।
राहदानी नम्बर {id} हरायो।
नागरिकता नम्बर {id} लेखिएको छ।
{name} ले पानी छैन भने।
हामी {address} मा बस्छौं।
सम्पर्क: {name}, {phone}
पत्र {email} मा पठाउनुहोस्।
नाम: {name}
डा. {name} आज आउनुहुन्न।
हाम्रो शिक्षक {name} हुनुहुन्छ।
पसल {address} मा छ।
फोन नम्बर {phone} फेरियो।
बिल नम्बर {ORDER} तिर्नुहोस्।
अर्डर {ORDER} आयो।
मूल्य {ORDER} रुपैयाँ हो।
मिति {DATE} मा मेला छ।""".split("\n"),
    "ta": """என் மின்னஞ்சல் {email}.
{phone} எண்ணை அழைக்கவும்.
அவர் முகவரி {address}.
நேற்று {name} சென்னை சென்றார்.
{name} மற்றும் {name} சந்தையில் இருந்தனர்.
கடவுச்சீட்டு எண் {id} தொலைந்தது.
அடையாள அட்டை எண் {id} ஆகும்.
{name} தண்ணீர் இல்லை என்றார்.
நாங்கள் {address} இல் வசிக்கிறோம்.
தொடர்பு: {name}, {phone}
கடிதத்தை {email} க்கு அனுப்பவும்.
பெயர்: {name}
டாக்டர் {name} இன்று வரமாட்டார்.
எங்கள் ஆசிரியர் {name}.
கடை {address} இல் உள்ளது.
தொலைபேசி எண் {phone} மாறியது.
ரசீது எண் {ORDER} செலுத்தவும்.
ஆர்டர் {ORDER} வந்தது.
விலை {ORDER} ரூபாய்.
தேதி {DATE} அன்று விழா.""".split("\n"),
    "lus": """Ka email chu {email} a ni.
{phone} ah hian min rawn be rawh.
{name} chu nimin ah a kal.
A chenna chu {address} a ni.
Passport number {id} a bo ta.
{name} leh {name} an inhmu.
Bill number {ORDER} pe rawh.""".split("\n"),
    "ja": """連絡先は{email}です。
電話は{phone}までお願いします。
旅券番号{id}を記入した。
注文番号{ORDER}を確認した。""".split("\n"),
}
#: Words that announce the number of a paper of a person, or another number, and what may stand before the number.
PAPERS = "passport|passport number|passport no.|national id|national ID|national ID number|ID|ID card|ID number|id card no.|identity card|identity number|driving licence|driver's license|license number|voter card|voter id|aadhaar|Aadhaar number|SSN|social security number|tax id|citizenship card|citizenship certificate|NID|residence permit|health card|insurance number|PAN|birth certificate no.|PASSPORT|PASSPORT NO".split("|")
OTHERS_NUMBERED = "order|order number|order no.|invoice|invoice number|bill no.|receipt|receipt number|ticket|ticket no.|booking|booking number|ISBN|book code|tracking code|serial number|batch|version|case number|part number|model|reference|reference no.|account|shelf mark|lot|chapter|article|item|flight|page|code|price|Order|Invoice|Ticket no.".split("|")
JOINTS = (" ", " ", ": ", " is ", " was ", " #", " (", " = ", " reads ", ", ", " numbered ", " with number ", " — ", " no. ")
LOCAL_ADDRESS = {
    "hi": "{n}, {p} मार्ग, {c}|मकान नं. {n}, {p} नगर, {c} - {z}|फ्लैट {n}, गली {m}, {c}|{n} {p} रोड, {c} {z}|{n}/{m} {p} गली, {c}",
    "ne": "{n} {p} मार्ग, {c} {z}|घर नं. {n}, वडा {m}, {c}|{p} टोल, घर {n}, {c}|{p} टोल, घर नं. {n}, {c} {z}|{n} {p} पथ, {c}",
    "bn": "{n} {p} সড়ক, {c}|বাড়ি {n}, সড়ক {m}, {c} {z}|বাসা নং {n}, {p} রোড, {c}|ফ্ল্যাট {n}, {m} {p} সরণি, {c}|{n}/{m} {p} লেন, {c}-{z}",
    "ta": "எண் {n}, {p} தெரு, {c}|வீடு {n}, {p} நகர், {c} - {z}|{n} {p} சாலை, {c}|எண் {n}/{m}, {p} வீதி, {c}",
}


class Inventor:
    """Fills slots; ``names``: known names by language, whose letter statistics make others; ``places``: words of each language."""

    def __init__(self, rng: random.Random, names: dict[str, list[str]], places: dict[str, list[str]]):
        self.rng, self.names, self.places = rng, names, places
        self.chains: dict[str, dict[str, list[str]]] = {}
        for lang, known in names.items():
            chain = self.chains.setdefault(lang, {})
            for name in known:
                units = ["^", *regex.findall(r"\X", name), "$"]
                for one, two in zip(units, units[1:]):
                    chain.setdefault(one, []).append(two)
        self.by_hold = {h: [(lang, s) for lang, lines in {"en": EN, **OTHERS}.items() for s in lines if held(s) == h] for h in (False, True)}

    def made_name(self, lang: str) -> str:
        """A name that follows the known ones unit by unit."""
        for _ in range(20):
            out, at = [], "^"
            while (at := self.rng.choice(self.chains[lang][at])) != "$" and len(out) < 12:
                out.append(at)
            if 2 <= len(out) <= 9:
                return "".join(out)
        return self.rng.choice(self.names[lang])

    def part(self, lang: str, listed: list[str]) -> str:
        kind = self.rng.random()
        if lang in self.chains and (lang != "en" or kind < 0.35):
            return self.rng.choice(self.names[lang]) if kind < 0.1 else self.made_name(lang)
        if kind < 0.5:
            return "".join(self.rng.choice("bdfghjklmnprstvz") + self.rng.choice(("a", "e", "i", "o", "u", "ae", "ou", "an", "el", "ir")) for _ in range(self.rng.randint(2, 3))).capitalize()
        return self.rng.choice(listed)

    def name(self, lang: str) -> str:
        if lang not in self.chains:
            lang = "en"
        middle = self.rng.random()
        mid = f"{self.rng.choice('ABCDEGHJKLMNPRSTVW')}. " if lang == "en" and middle < 0.12 else f"{self.part(lang, GIVEN)} " if middle > 0.93 else ""
        return f"{self.part(lang, GIVEN)} {mid}{self.part(lang, FAMILY)}"

    def number(self, form: str, lang: str = "en", native: float = 0.5) -> str:
        r = self.rng
        out = "".join(str(r.randrange(10)) if c == "#" else str(r.randrange(2, 10)) if c == "2" and form.startswith("2#") else r.choice("ABCDEFGHJKLMNPRSTUVWXYZ") if c == "A" else c for c in form)
        if lang in DIGITS and r.random() < native:
            out = out.translate({48 + k: DIGITS[lang] + k for k in range(10)})
        return out

    def word(self) -> str:
        return self.rng.choice(WORDS) if self.rng.random() < 0.4 else self.part("xx", GIVEN + FAMILY).lower().replace("'", "")

    def email(self, lang: str) -> str:
        r, w = self.rng, self.word
        n = str(r.randrange(1, 2030))
        local = r.choice((lambda: f"{w()}.{w()}", lambda: f"{w()[0]}.{w()}{n}", lambda: w() + n, lambda: f"{w()}_{w()}", lambda: f"{w()}+{w()[:4]}", lambda: f"{w()}-{w()[:5]}", lambda: w(), lambda: f"{w()}{w()}", lambda: r.choice(("info", "sales", "office", "admin", "support", "contact", "hello"))))()
        domain = r.choice((lambda: r.choice(("gmail.com", "yahoo.com", "outlook.com", "hotmail.com", "proton.me", "yahoo.co.in", "icloud.com")), lambda: f"{w()}.{tld()}", lambda: f"{w()}-{w()}.{tld()}", lambda: f"{r.choice(('mail', 'post', 'www', 'dept', w()))}.{w()}.{tld()}", lambda: f"{w()}.co.uk"))
        tld = lambda: r.choice(("com", "org", "net", "edu", "in", "io", "de", "fr", "example", "invalid", "test", "np", "bd", "co", "info"))
        host, how = domain(), r.random()
        if how < 0.72:
            out = f"{local}@{host}"
        elif how < 0.76:
            out = f"{local}＠{host}"
        else:
            at = r.choice((" at ", " (at) ", " [at] ", "(at)", "[at]", " {at} ", " AT "))
            dot = r.choice((" dot ", " DOT ")) if at.strip().isalpha() else r.choice((".", " dot ", " (dot) ", " [dot] ", "[dot]", "(dot)"))
            out = local + at + host.replace(".", dot)
        return out.upper() if r.random() < 0.08 else out

    def phone(self, lang: str, marked: bool = False) -> str:
        """A phone number; a marked one tells what it is by its own form."""
        while True:
            form = self.rng.choice(PHONES)
            if not marked or form[0] in "+(" or form.count("-") + form.count(".") + form.count(" ") > 1 and form.count("#") > 9:
                return self.number(form, lang)

    def address(self, lang: str) -> str:
        r = self.rng
        if lang in LOCAL_ADDRESS and r.random() < 0.85:
            p, c = (r.choice(self.places[lang]) for _ in range(2))
            out = r.choice(LOCAL_ADDRESS[lang].split("|")).format(n=r.randrange(1, 200), m=r.randrange(1, 60), p=p, c=c, z=r.randrange(1000, 999999))
            return self.number(out.replace("#", ""), lang)
        way = " ".join([self.part("en", FAMILY) if r.random() < 0.5 else r.choice(WORDS).capitalize()] + ([r.choice(WORDS).capitalize()] if r.random() < 0.15 else []) + [r.choice(WAYS)])
        n = str(r.randrange(1, 400)) + (r.choice("ABCD") if r.random() < 0.15 else "") + (f"/{r.randrange(1, 90)}" if r.random() < 0.12 else "")
        out = r.choice((f"{n} {way}", f"{n} {way}", f"{n}, {way}", f"no. {n}, {way}", f"No. {n}, {way}", f"House {n}, Road {r.randrange(1, 40)}", f"Flat {n}, {r.randrange(1, 99)} {way}", f"Plot no. {n}, Sector {r.randrange(1, 60)}", f"Apartment {n}, {way}", f"Unit {r.randrange(1, 30)}, {n} {way}"))
        city = r.choice(CITIES) if r.random() < 0.5 else self.part("en", FAMILY)
        zip_ = r.choice(("", "", f" {r.randrange(10000, 999999)}", f" - {r.randrange(100000, 999999)}", f" {self.number('AA# #AA')}", f", CA {r.randrange(90000, 99999)}"))
        return out + ("" if r.random() < 0.15 else f", {city}{zip_}")

    def fill(self, slot: str, lang: str) -> tuple[str, int | None]:
        """(text, kind) of a slot."""
        r = self.rng
        if slot in ("name", "email", "phone", "address"):
            return getattr(self, slot)(lang), KINDS.index(slot)
        if slot == "fphone":
            return self.phone(lang, True), KINDS.index("phone")
        if slot == "id":
            return self.number(r.choice(IDS), lang), KINDS.index("id_number")
        big = lambda: r.choice(WORDS).capitalize()
        return {
            "ORDER": lambda: self.number(r.choice(ORDERS), lang),
            "MONTH": lambda: r.choice(MONTHS),
            "YEAR": lambda: str(r.randrange(1800, 2030)),
            "DATE": lambda: self.number(r.choice(("12-0#-20##", "2#/0#/20##", "20##-1#-0#", "3 May 20##", "1#.0#.19##")), lang),
            "CITY": lambda: r.choice((r.choice(CITIES), self.part("en", FAMILY), f"New {r.choice(CITIES)}")) if lang not in self.places or lang == "en" else r.choice(self.places[lang]),
            "WORD": self.word,
            "ORG": lambda: r.choice((f"{big()} {r.choice(('School', 'Bank', 'Society', 'Company', 'Museum', 'Library'))}", f"{r.choice(CITIES)} University", f"The {big()} {big()} Trust", f"{r.choice(FAMILY)} and Sons")),
            "PLACE": lambda: r.choice((f"{big()} {r.choice(('Park', 'Lake', 'Bridge', 'Castle', 'Hill', 'Market'))}", f"Lake {big()}", f"{big()} {r.choice(WAYS)}", f"Mount {self.part('en', FAMILY)}")),
            "TITLE": lambda: f"The {big()} {big()}",
        }[slot](), None

    def phrase(self) -> tuple[str, list[tuple[int, int, int]]]:
        """A piece that can stand anywhere in English prose: it tells by itself what it is."""
        r = self.rng
        slot = r.choice(("name", "name", "name", "email", "fphone", "address", "address", "PAPER", "PAPER", "ORDER", "ORDER", "ORG", "PLACE", "TITLE", "CITY"))
        if slot in ("PAPER", "ORDER"):
            text, kind = self.number(r.choice(IDS if slot == "PAPER" else ORDERS)), KINDS.index("id_number") if slot == "PAPER" else None
            start = r.choice(("", "", "the ", "my ", "his ", "her ", "new ", "a ")) + r.choice(PAPERS if slot == "PAPER" else OTHERS_NUMBERED) + r.choice(JOINTS)
        else:
            text, kind = self.fill(slot, "en")
            start = r.choice(("", "", "", "", {"name": "Dr. ", "email": "mail ", "fphone": "tel. ", "address": "at "}.get(slot, "the ")))
        end = ")" if start.endswith("(") else r.choice(("", "", "", "'s")) if slot in ("name", "ORG", "CITY") else ""
        return start + text + end, [] if kind is None else [(len(start), len(start) + len(text), kind)]

    def sentence(self, lang: str | None, from_held: bool) -> tuple[str, list[tuple[int, int, int]], str]:
        """(text, spans, language)."""
        choices = self.by_hold[from_held]
        own = [x for x in choices if x[0] == lang] if lang else choices
        lang, line = self.rng.choice(own or choices)
        out, spans, at = "", [], 0
        for m in SLOT.finditer(line):
            out += line[at : m.start()]
            text, kind = self.fill(m[1], lang)
            if kind is not None:
                spans.append((len(out), len(out) + len(text), kind))
            out, at = out + text, m.end()
        return out + line[at:], spans, lang


def held(line: str) -> bool:
    """Whether a sentence is kept from training."""
    return zlib.crc32(line.encode()) % HELD == 0
