"""Surrogates: their properties, and the whole result against plain Python."""

import hashlib
import re

import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandweave.llm import pii

from .test_text_operators import UPPER, docs

KEY = "a key"

PRIVATE = [
    "mail Bob.Smith@Mail.org or bob.smith@mail.org now", "call +1 (988) 555-2485 or +1 988-555-2485", "card 4111 1111 1111 1111 and 4111111111111111 or 4111111111111112", "ip 10.1.2.3. ssn 123-45-6789",
    "Dear Mrs. Jane Doe and Mr Karl Doe", "IBAN DE89 3704 0044 0532 0130 00", 'password=b7db7aa4a5fcc78305 token = "1beb58b8af6c509b1"', "г-жа Анна Петрова и г-н Пётр Анин",
]


def luhn(digits):
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(int(c) for c in reversed(digits))) % 10 == 0


def test_surrogates(spark):
    clean = ["no data, 12 of 345 things; 1.5 and 2024-01-02", "Mr is a title", None, "", "x" * 9000]
    rows = docs(spark, [*PRIVATE, *clean, PRIVATE[0]])
    got = [r for r in pii.replace_entities(rows, KEY, count_col="k").orderBy("doc_id").collect()]
    new = [r.text for r in got]
    assert [r.k for r in got] == [2, 2, 3, 2, 2, 1, 2, 2, 0, 0, 0, 0, 0, 2]
    assert new[8:13] == clean and new[13] == new[0] and all(r.n_chars == (None if r.text is None else len(r.text)) for r in got)
    for old in ("bob.smith", "555-2485", "4111", "10.1.2.3", "123-45", "Jane", "Karl", "3704", "b7db7", "1beb5", "Анна"):
        assert not any(old.lower() in (t or "").lower() for t in new)
    a, b = re.findall(r"\S+@\S+", new[0])
    assert a == b and ".example." in a
    phones = re.findall(r"\+1 .{14}|\+1 .{12}", new[1])
    digits = [re.sub(r"\D", "", p) for p in re.findall(r"\+1[ ()\d-]+\d", new[1])]
    assert digits[0] == digits[1] and phones and re.match(r"call \+1 \(\d{3}\) \d{3}-\d{4} or \+1 \d{3}-\d{3}-\d{4}$", new[1])
    cards = [re.sub(" ", "", c) for c in re.findall(r"\d{4} \d{4} \d{4} \d{4}|\d{16}", new[2])]
    assert cards[0] == cards[1] != cards[2] and luhn(cards[0]) and all(c[0] == "4" for c in cards)
    women, men = pii.GIVEN["latin"]["f"], pii.GIVEN["latin"]["m"]
    m = re.fullmatch(r"Dear Mrs\. (\w+) (\w+) and Mr (\w+) (\w+)", new[4])
    assert m[1] in women and m[3] in men
    m = re.fullmatch(r"г-жа (\w+) (\w+) и г-н (\w+) (\w+)", new[7])
    assert m[1] in pii.GIVEN["cyrillic"]["f"] and m[3] in pii.GIVEN["cyrillic"]["m"]
    assert re.fullmatch(r"IBAN DE\d\d( \d{4}){4} \d\d", new[5])
    assert re.fullmatch(r'password=[0-9a-f]{18} token = "[0-9a-f]{17}"', new[6])
    other = pii.replace_entities(docs(spark, PRIVATE[:1]), "another").first().text
    assert other != new[0]


def test_secrets_without_digits(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    keys = [w.replace("_", sep) for w in ("password", "passwd", "pwd", "secret", "token", "api_key", "access_key") for sep in ("_", "-", "")]
    secrets = [f"{case(w)}{sign}{letters[:12]}" for w in keys for case in (str.lower, str.upper, str.title) for sign in ("=", " : ")]
    secrets += ["AKIA" + UPPER[:16], "ghp_" + (letters + UPPER)[:36], "sk-" + letters[:20]]
    rows = docs(spark, [f"so {x} it is" for x in secrets])
    got = pii.replace_entities(rows, KEY, count_col="k").orderBy("doc_id").collect()
    assert [r.k for r in got] == [1] * len(secrets)
    assert not any(r.text == f"so {x} it is" for r, x in zip(got, secrets, strict=True))


def test_surrogates_stay_distinct(spark):
    names = [f"Mr {a}{b}" for a in UPPER for b in "abcdefghijklmnopqrstuvwxyzéèüö"]
    ips = [f"{i}.{j}.7.9" for i in range(1, 40) for j in range(0, 250, 10)]
    rows = docs(spark, [" and ".join(names) + ".", " or ".join(ips)])
    got = {r.doc_id: r.text for r in pii.replace_entities(rows, KEY).collect()}
    assert len(set(got[0].rstrip(".").split(" and "))) == len(names)
    assert len(set(got[1].split(" or "))) == len(ips)


def test_surrogate_edges(spark):
    rows = docs(spark, ["a@b.org", "c@d.org x", "a@b.org", None], [1, 1, None, None]).withColumn("raw", F.lit(1)).withColumn("new", F.lit("c")).drop("n_chars")
    got = pii.replace_entities(rows, KEY)
    assert got.columns == rows.columns and got.count() == 4
    assert not got.where("text like '%b.org%' or text like '%d.org%'").count()
    assert pii.replace_entities(rows.limit(0), KEY).count() == 0


def sha(*parts):
    return hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()


def ascii_classes(pattern):
    """The pattern with digits, word signs and white space of ASCII alone, as Java has them."""
    out, inside, i = "", False, 0
    while i < len(pattern):
        c = pattern[i : i + 2] if pattern[i] == "\\" else pattern[i]
        i += len(c)
        inside = c == "[" or (inside and c != "]")
        body = {"\\d": "0-9", "\\w": "A-Za-z0-9_", "\\s": " \\t\\n\\x0b\\f\\r"}.get(c)
        out += c if body is None else body if inside else f"[{body}]"
    return out


ANY, HINT = ascii_classes(pii.ANY), ascii_classes(pii.HINT)


class Brute:
    """The operator in plain Python: one text after the other, one entity after the other."""

    def __init__(self, texts, key):
        self.key = key
        self.found = [[m[0] for m in regex.finditer(ANY, t or "")] for t in texts]
        raws = sorted({x for own in self.found for x in own})
        self.kind = {x: next(k for k, p in pii.PATTERNS.items() if regex.fullmatch(ascii_classes(p), x)) for x in raws}
        self.bare = {x: self.canonical(x) for x in raws}
        titles = {x: next((g for g in "fmn" if regex.match(rf"(?:{'|'.join(pii.TITLES[g])})\.? ", x)), "n") if k == "name" else "n" for x, k in self.kind.items()}
        self.who = {}
        for x in raws:
            others = {titles[y] for y in raws if (self.kind[y], self.bare[y]) == (self.kind[x], self.bare[x])} - {"n"}
            self.who[x] = (self.kind[x], self.bare[x], titles[x] if len(others) == 2 else next(iter(others), "n"))
        surnames = {("family", b.split(" ")[-1], "n") for k, b, _ in self.who.values() if k == "name"}
        real = {(k, b) for k, b, _ in {*self.who.values(), *surnames}}
        self.new = self.settle({*surnames, *(w for w in self.who.values() if w[0] != "name")}, real)
        self.new |= self.settle({w for w in self.who.values() if w[0] == "name" and " " in w[1]}, real)
        self.texts = [None if t is None else regex.sub(ANY, lambda m: self.written(m[0]), t) for t in texts]

    def canonical(self, x):
        kind = self.kind[x]
        digits = re.sub("[^0-9]", "", x)
        if kind == "name":
            return regex.sub(rf"^(?:{pii._TITLE})\.? ", "", x).lower()
        if kind == "secret":
            return re.sub("[\"']$", "", re.sub(pii._SECRET_VALUE, "", x))
        return x.lower() if kind == "email" else x.replace(" ", "") if kind == "iban" else x if kind == "ip" else digits[self.code(x) :] if kind == "phone" else digits

    def code(self, x):
        return len(re.match(pii._CODE, re.sub("[^0-9]", "", x))[0]) if x.startswith("+") else 0

    def settle(self, open_, real):
        done, taken, attempt = {}, set(), 0
        while open_:
            drawn = {}
            for w in open_:
                drawn.setdefault((w[0], self.draw(*w, attempt)), []).append(w)
            for name, ws in drawn.items():
                if name not in real and name not in taken:
                    taken.add(name)
                    done[min(ws)] = name[1]
            open_, attempt = open_ - set(done), attempt + 1
        return done

    def draw(self, kind, bare, gender, attempt):
        seed = "|".join([self.key, kind, *([gender] if kind == "name" else []), bare, str(attempt)])
        stream = bytes.fromhex("".join(sha(seed, i) for i in range((len(bare) + 8) // 32 + 1)))
        script = "cyrillic" if regex.search(r"\p{IsCyrillic}", bare) else "greek" if regex.search(r"\p{IsGreek}", bare) else "latin"

        def pour(text, hexadecimal=False):
            out = ""
            for c, b in zip(text, stream, strict=False):
                out += str(b % 10) if c in "0123456789" else ("abcdef"[b % 6] if hexadecimal else chr(97 + b % 26)) if "a" <= c <= "z" else chr(65 + b % 26) if "A" <= c <= "Z" else c
            return out

        plain = pour(bare, re.fullmatch("[0-9a-f]+", bare))
        if kind == "email":
            local, _, domain = bare.partition("@")
            top = domain.rpartition(".")[2]
            return f"{pour(local)}@d{sha(self.key, 'domain', domain)[:8]}.example.{top if top in ('com', 'net', 'org') else 'com'}"
        if kind == "ip":
            return ".".join(map(str, [240 + stream[0] % 15, *stream[1:4]]))
        if kind == "card":
            card = bare[0] + plain[1:]
            return card if luhn_sum(bare) else card[:-1] + str(-luhn_sum(card[:-1] + "0") % 10)
        if kind == "family":
            of = pii.SYLLABLES[script]
            return "".join(of[int(sha(seed, i)[:4], 16) % len(of)] for i in range(1, 4 + attempt)).capitalize()
        if kind == "name":
            out = []
            for i, word in enumerate(bare.split(" ")[:-1], 1):
                of = pii.GIVEN[script][gender]
                whole = "-".join(of[int(sha(seed, i, k)[:4], 16) % len(of)].lower() for k in range(attempt + 1))
                out.append(whole[0] + "." if not attempt and word.endswith(".") else whole)
            return " ".join([*out, self.new["family", bare.split(" ")[-1], "n"]])
        return "9" + plain[1:] if kind == "ssn" else bare[:2] + plain[2:] if kind == "iban" else plain

    def written(self, x):
        kind, bare, _ = self.who[x]
        new = self.new["family", bare, "n"] if kind == "name" and " " not in bare else self.new[self.who[x]]
        if kind == "name":
            title = regex.match(rf"(?:{pii._TITLE})\.? ", x)[0]
            shown = re.sub(r"(^|[ -])(\w)([^ -]*)", lambda m: m[1] + m[2].upper() + m[3].lower(), new) if regex.search(r"\p{Ll}", x[len(title) :]) else new.upper()
            return title + shown
        if kind == "secret":
            return re.match(pii._SECRET_VALUE, x)[0] + new + (x[-1] if x[-1] in "\"'" else "")
        if kind in ("email", "ip"):
            return new
        signs, skip = iter(new), self.code(x) if kind == "phone" else 0
        out = ""
        for c in x:
            if kind == "iban" and c != " ":
                out += next(signs)
            elif kind != "iban" and c in "0123456789":
                skip, c = (skip - 1, c) if skip else (0, next(signs))
                out += c
            else:
                out += c
        return out


def luhn_sum(digits):
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(int(c) for c in reversed(digits))) % 10


def test_surrogates_equal_plain_python(spark):
    texts = [*PRIVATE, PEOPLE, PHONES, " and ".join(f"Mr {a}{b} Lee" for a in UPPER[:9] for b in "abcdefgh") + ".", " or ".join(f"{i}.7.7.9" for i in range(1, 256)), "", None, "no data 12"]
    texts += ["mail a.b@c.de, A.B@C.DE and x@y.co.uk", "Dr J. R. Tolkien and Mr J. R. Tolkien", "MR X is no name; Mr KARL DOE is", 'pwd: "abcdefgh1"; AKIA' + UPPER[:16]]
    got = [(r.text, r.k) for r in pii.replace_entities(docs(spark, texts), KEY, count_col="k").orderBy("doc_id").collect()]
    want = Brute(texts, KEY)
    assert got == list(zip(want.texts, map(len, want.found), strict=True))


PHONES = "+1 415 555 2671, +14155552671, +1 (415) 555-2671, 415-555-2671, +44 20 7946 0958 and +442079460958, +420 601 123 456"
PEOPLE = "Mr Alex Kim met Ms Alex Kim. Mr John Ronald Tolkien, Mr Tolkien and Mrs Edith Mary Tolkien; Dr Jane Doe or Mrs Jane Doe"


def test_phones_are_one_in_every_format(spark):
    new = pii.replace_entities(docs(spark, [PHONES]), KEY).first().text
    parts = re.split(", | and ", new)
    assert all(p[:2] == "+1" for p in parts[:3]) and all(p[:3] == "+44" for p in parts[4:6]) and parts[6][:4] == "+420"
    bare = [re.sub(r"\D", "", p) for p in parts]
    assert bare[0] == bare[1] == bare[2] == "1" + bare[3] and bare[4] == bare[5]
    assert not any(x in new for x in ("2671", "0958", "555", "123 456"))


def test_people_keep_gender_surname_and_length(spark):
    new = pii.replace_entities(docs(spark, [PEOPLE]), KEY).first().text
    m = re.fullmatch(r"Mr (\w+) (\w+) met Ms (\w+) (\w+)\. Mr (\w+) (\w+) (\w+), Mr (\w+) and Mrs (\w+) (\w+) (\w+); Dr (\w+) (\w+) or Mrs (\w+) (\w+)", new)
    women, men = pii.GIVEN["latin"]["f"], pii.GIVEN["latin"]["m"]
    assert m[1] in men and m[3] in women and m[2] == m[4]
    assert m[5] in men and m[6] in men and m[7] == m[8] == m[11] and m[9] in women and m[10] in women
    assert (m[12], m[13]) == (m[14], m[15]) and m[12] in women
    assert not any(x in new for x in ("Tolkien", "Kim", "Doe"))


def test_the_hint_covers_the_patterns():
    words = ["password", "PassWD", "pwd", "secret", "Token", "api-key", "API_KEY", "access key", "accesskey", "=", ":", " = ", "'", "AKIA", "ghp_", "sk-", "Mr ", "Ms. ", "г-жа ", "Анна", "Karl", "abcdefghijklmnop" * 3, "@", "a.b", "1.2.3.4", "+1 ", "555-1234", "DE89", " "]

    @settings(max_examples=400, deadline=None)
    @given(st.lists(st.sampled_from(words), max_size=6).map("".join))
    def run(text):
        assert not regex.search(ANY, text) or regex.search(HINT, text)

    run()


def test_a_key_must_be_given(spark):
    with pytest.raises(ValueError):
        pii.replace_entities(docs(spark, ["x"]), "")
