"""Names of catalogs in texts, and replies freed from names and signatures."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from voxmill.functions import cleaning
from voxmill.functions.cleaning import Names, cleaned

BRANDS = Names(["Acme", "Other", "Acme Plus", "Yell!", "Ünder_1"])


@pytest.mark.parametrize(("said", "wanted"), [
    ("Schreib über die Adresse deines Acme-Kontos an support@de.acme.example oder besuche https://acme.example/help, dann helfen wir", "Schreib über die Adresse deines {app_name}-Kontos an {support_contact} oder besuche {support_contact} dann helfen wir"),
    ("hi John, thanks for the feedback ! mail help@x.example 🙂", "Hi, thanks for the feedback! mail {support_contact}"),
    ("Dear Anna Maria: your review made our day", "Dear, your review made our day"),
    ("Hi Anna Maria Lopez, your review made our day", "Hi Anna Maria Lopez, your review made our day"),
    ("Hello Team! Your review made our day", "Hello Team! Your review made our day"),
    ("Hey O'Neil-Smith , your review made our day", "Hey, your review made our day"),
    ("Gracias por tu comentario, Fernando Pacay. Nos alegra.", "Gracias por tu comentario. Nos alegra."),
    ("We read your message,Ida! We will answer the comment All.", "We read your message! We will answer the comment All."),
    ("Omar Ali, thankfully you told us about it", "Thankfully you told us about it"),
    ("Obrigado pela avaliação, ficamos felizes que goste. Saudações", "Obrigado pela avaliação, ficamos felizes que goste."),
    ("We shared your idea (today) kind regards – your Acme-Support", "We shared your idea (today)"),
    ("We shared your idea now! Mit freundlichen Grüßen, dein Acme Team", "We shared your idea now!"),
    ("We shared your idea now! Take care; support team!", "We shared your idea now! Take care; support team!"),
    ("We shared your idea now! Take care; support team", "We shared your idea now!"),
    ("We shared your idea now! Best, many thanks to you", "We shared your idea now! Best, many thanks to you"),
    ("We fixed Acme Plus and ACME and Yell! in it", "We fixed {app_name} and {app_name} and {app_name} in it"),
    ("We know Acmes and xYell! and {Acme} but ünder_1 too", "We know Acmes and xYell! and {Acme} but {app_name} too"),
    ("We fixed it for all of you.\n\nCheers\nSeu Time Acme\n", "We fixed it for all of you."),
    ("We fixed it for all of you.\nYour whole friendly app team", "We fixed it for all of you. Your whole friendly app team"),
    ("", None), (None, None), ("🙂", None), ("Thanks, Anna!", None), ("some more words " * 22 + "cut...", None), ("x" * 400 + " a b c d e", "X" + "x" * 399 + " a b c d e"),
])
def test_cleaned(said, wanted):
    assert cleaned(said, BRANDS) == wanted


def test_names_against_one_pattern_each():
    r = random.Random(4)
    words = ["Ab", "ab", "cd", "Ef", "gh", "-", "!", " ", " ", " ", "{", "}", "x1", "."]
    for _ in range(400):
        names = ["".join(r.choices(words, k=r.randint(1, 4))).strip() for _ in range(4)]
        names = [n for n in names if n]
        text = "".join(r.choices(words, k=25))
        wanted = text
        for name in sorted({n.lower() for n in names}, key=lambda n: -len(n)):
            wanted = re.sub(rf"(?<![\w{{]){re.escape(name)}(?!\w)", "\0", wanted, flags=re.IGNORECASE)
        if len({len(n) for n in {n.lower() for n in names}}) == len({n.lower() for n in names}):
            assert Names(names).replaced(text, "\0") == wanted, (names, text)
        assert Names(names).within(text) == any(re.search(rf"(?<!\w){re.escape(n)}(?!\w)", text, re.IGNORECASE) for n in names)


def test_a_large_catalog_takes_one_pass(spark):
    names = [f"Brand{k} {k % 97}" for k in range(100_000)]
    rows = [(k, f"We like brand{k * 31} {k * 31 % 97} and brand{k} a lot, Brand{k}") for k in range(3000)]
    began = time.time()
    out = spark.createDataFrame(rows, "id long, said string").select("id", cleaning.clean_reply(F.col("said"), names).alias("x"), cleaning.mentions(F.col("said"), names).alias("m")).collect()
    assert all(r.x == f"We like {{app_name}} and brand{r.id} a lot, Brand{r.id}" and r.m for r in out) and time.time() - began < 60
