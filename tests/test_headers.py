"""File names of headers against the library that reads one at a time."""

import base64
import quopri
import random

from pyspark.sql import functions as F

from dossier.sources import files


def word(text, charset, kind):
    data = text.encode(charset)
    if kind in "Bb":
        return f"=?{charset}?{kind}?{base64.b64encode(data).decode()}?="
    return f"=?{charset}?{kind}?{quopri.encodestring(data, quotetabs=True).decode().replace('=\n', '').replace(' ', '_').replace('?', '=3F')}?="


def test_encoded_words(spark):
    rng = random.Random(3)
    names = []
    for charset, letters in (("utf-8", "լոտé漢 a"), ("UTF-8", "Лот№ "), ("iso-8859-1", "éü a"), ("windows-1251", "Лот№ э"), ("koi8-r", "Лот э"), ("us-ascii", "abc")):
        for kind in "BbQq":
            text = "".join(rng.choice(letters) for _ in range(8)).strip() or "x"
            names += [word(text, charset, kind), word(text, charset, kind) + " " + word("2" + text, charset, kind), word(text, charset, kind) + "\t" + word("z", "utf-8", "Q")]
    data = "Լոտեր".encode()
    names += ["=?utf-8?B?" + base64.b64encode(data[:3]).decode() + "?= =?utf-8?B?" + base64.b64encode(data[3:]).decode() + "?=", word("é", "utf-8", "B") + " .pdf", "a " + word("é", "utf-8", "Q"), "=?utf-8?B?/w==?=", "=?nowhere?B?YQ==?=", "plain.pdf", "a =? b", "=?utf-8*en?Q?a_b?="]
    headers = [f'attachment; filename="{n}"' for n in names] + [f"attachment; filename={n}" for n in names if " " not in n and "\t" not in n and ";" not in n and "=" not in n]
    got = {r.h: r.n for r in spark.createDataFrame([(h,) for h in headers], "h string").select("h", files.header_file_name(F.col("h")).alias("n")).collect()}
    for h in headers:
        assert got[h] == files.header_name(h), h
