import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))


from abuse_sentences import ABUSIVE
from abuse_sentences import HARMLESS as PLAIN

from tasselworks.llm import voters
from tasselworks.llm.abuse import N_VOTERS, LabelModel, fit, passages, plain_form, score, score_documents, source_rates, votes
from tasselworks.session import Workspace

ABUSE = [
    "You stupid moron, even a goat labels better than you.", "Go to hell, you useless pig!", "I hate migrants; they breed like vermin and deserve to be starved.",
    "Ojalá te coman los perros.", "Cala a boca, imbecil.", "Send me nudes, I am so horny tonight.", "Foreigners are subhuman and should be locked up.", "I will find your house and break your legs.",
]
DISGUISED = ["You stupid m-o-r-o-n, even a g0at labels better than you.", "Go to hell, you usеlеss PIG!", "What a pathetic idiiiiot you are.", "Send me n​udes, I am so h0rny tonight.", "Cala a boca, imb3cil."]
HARMLESS = [
    "Kill the aphids early: they are vermin and should be wiped out at V8.", "Use the idiot-proof card, it beats the tripod.", "The lesions can be seen with the naked eye at V6.", "Damn rain again, 12 frames are tilted.",
    "Os parasitas do grão são uma praga em Campo Norte.", "Blur variance was 2.4 and brightness 36.", "La hoja bandera muestra manchas acuosas.", "File northern_corn_leaf_blight_maize_africa_real_4631996.jpg is tilted.",
]


def corpus():
    rng = random.Random(7)
    rows = []
    for k in range(1500):
        parts = [rng.choice(HARMLESS) for _ in range(rng.randrange(1, 5))]
        bad = k % 12 == 0
        if bad:
            parts.insert(rng.randrange(len(parts) + 1), rng.choice(ABUSE))
        rows.append((k, " ".join(parts), f"s{k % 3}", bad, None))
    return rows


def test_disguises_are_undone():
    assert passages("You m-o-r-o-n.\nplain text. f\u200bo\u200bo")[0] == ("you moron", True)
    assert [p for p, _ in passages("n u d e s here! idiiiiot v12 b1tch o**rio 5ex0. uselesssss f*ck y o u a r e a m o r o n")] == ["nudes here", "idiot v12 bitch otario sexo", "useless fuck you are a moron"]
    # what is no known word stays as it is
    assert passages("leaf_spot 2nd r1 x_y maize_field a*b 12 kg/ha B. zeae") == [("leaf_spot 2nd r1 x_y maize_field a*b 12 kg/ha b", False), ("zeae", False)]
    assert passages(None) == [] and passages("  \n . ") == []
    assert votes("kill the aphids early: they are vermin and should be wiped out", False).bit_count() == 1


def bits(*names):
    return sum(1 << voters.NAMES.index(n) for n in names)


def test_label_model_estimates_accuracies_from_what_others_say():
    good, bad, company, pest = bits("contempt"), bits("threat"), bits("insult_direct"), bits("pest_talk")
    harmless, abusive = 1 << N_VOTERS, 2 << N_VOTERS
    # raters contradict one telling voter and back two others; where nobody rates, the voter still fires as often
    counts = {0: 200_000, 0 | harmless: 4000, 0 | abusive: 150, good: 300, good | abusive: 60, good | harmless: 3, company | abusive: 50, company: 200, bad: 900, bad | harmless: 95, bad | abusive: 5, pest: 5000, pest | harmless: 300, good | company: 80}
    model = LabelModel(counts)
    alpha = dict(zip(voters.NAMES, model.alpha))
    assert alpha["contempt"] > 0.9 and alpha["insult_direct"] > 0.9 and alpha["threat"] < 0.2 and alpha["pest_talk"] < 0.01
    assert model.judge([good])[0] > 0.9 > 0.3 > model.judge([bad])[0] and model.judge([0])[0] < 0.02
    # voters that fire together are worth less than independent ones
    twins = LabelModel({0: 100_000, good | company: 500, 1 << 5: 3})
    assert twins.corr[voters.NAMES.index("contempt"), voters.NAMES.index("insult_direct")] > 0.5
    assert LabelModel({}).posterior == {}


def test_documents(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, bad boolean, score double")
    ratings = spark.createDataFrame([(r[0], "a", int(r[3] != (r[0] % 40 == 0))) for r in rows[::9]] + [(1, "b", None), (1, "c", 1), (1, "c", 1), (1, "d", 0), (1, "e", 0)], "doc_id long, rater string, is_abusive int")
    _, weights = fit(plain_form(df, Workspace(spark, "t")), ratings)
    fresh = [(10_000 + k, t, None, k < len(DISGUISED + ABUSE), None) for k, t in enumerate(DISGUISED + ABUSE + HARMLESS)]
    fresh += [(20_000, None, "n", False, None), (20_001, "", "n", False, None), (20_002, "x " * 50_000 + "\n" + ABUSE[0], "n", True, None)]
    scored = score_documents(plain_form(spark.createDataFrame(rows + fresh, df.schema), Workspace(spark, "t")), weights)
    got = {r.doc_id: r.score for r in scored.collect()}
    wrong = [r for r in rows + fresh if (got[r[0]] >= 0.5) != r[3]]
    assert not wrong, wrong[:3]
    rates = {r.source: r for r in source_rates(scored).collect()}
    assert rates["s0"].n_docs == 500 and rates["n"].n_flagged == 1 and None in rates


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    ratings = spark.createDataFrame([], "doc_id long, is_abusive int")
    table = plain_form(df, Workspace(spark, "t"))
    _, weights = fit(table, ratings)
    assert score_documents(table, weights).count() == 0


def test_unseen_sentences(spark):
    """Fitted on the test tables; the sentences share no clause with them or with the voters."""
    sf = "/root/testdata/sf0.01"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    table = plain_form(spark.read.parquet(f"{sf}/documents.parquet"), Workspace(spark, "t"))
    _, weights = fit(table, spark.read.parquet(f"{sf}/content_labels.parquet"))
    for part in (0, 1):
        found = [score(t, weights) >= 0.5 for t in ABUSIVE[part::2]]
        wrong = [score(t, weights) >= 0.5 for t in PLAIN[part::2]]
        assert len(found) + len(wrong) >= 100
        assert sum(found) / len(found) >= 0.9 and sum(found) / (sum(found) + sum(wrong)) >= 0.9, (part, sum(found), len(found), sum(wrong))


def test_asking_only_where_a_needed_word_stands_changes_nothing():
    rng = random.Random(3)
    texts = ABUSE + DISGUISED + HARMLESS + ABUSIVE + PLAIN
    mixed = [" ".join(rng.choice(texts).split()[: rng.randrange(1, 9)] + rng.choice(texts).split()[-rng.randrange(1, 9) :]) for _ in range(4000)]
    for text in texts + mixed:
        for p, _ in passages(text):
            words = voters.re.findall("[a-z]+", p)
            asked = 0
            for w in words:
                asked |= voters.ASKED.get(w, 0)
            for k, search in enumerate(voters._SEARCH):
                assert search is None or not search(p) or asked >> k & 1, (p, voters.NAMES[k], search(p))
