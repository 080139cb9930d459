import random
import re

import pytest
from pyspark.sql import functions as F

from quern.llm import abuse, automata
from quern.llm.automata import Composed, Machine

GRAMMAR = abuse.Grammar()
CASES = [
    "you are a stupid clown", "You are a brainless idiot!!!", "What a filthy loser you are, Ann", "shut up you useless rat", "nobody asked you, spineless maggot", "Rotten pig. that is all you are",
    "kill yourself, weasel", "I hope a truck hits you", "we are coming for you and your kids", "i will find where you live and break your ribs", "someone should burn your house down, Bob",
    "Tordeno should be hanged from a lamp post", "people like you should be put down like sick dogs", "you deserve to be beaten until you beg", "keep posting and you end up in a ditch",
    "Marshlings are not even human", "all Blues are vermin and should be driven out", "never hire Reds, they all steal and stink", "send every one of them back across the river",
    "send me nudes and i will pay you", "hot naked women on cam tonight, dm me", "free xxx sex tape download here", "i want to lick every inch of your naked body",
    "du bist ein wertloser Versager", "halt die Fresse, du Drecksack", "cállate, pedazo de inútil", "ojalá te mueras, imbécil", "cala a boca, seu otário", "ferme ta gueule, espèce de déchet", "tu es un connard fini", "mulheres peladas ao vivo, sexo grátis",
    # disguised
    "you are a st​upid clоwn", "what a u g l y r4t you are", "y0u are a w*******s d****t", "5p1n3l355 dumbass. that is all you are", "kiiill yourself, b.i.t.c.h", "FREE X*X S'EX TAPE DOWNLOAD HERE", "nobody asked you, v i l e m.o.r.o.n",
    '{"name": "x", "about": "nobody asked you, vile moron", "nip05": "x@y"}', "A long calm note about the garden and the river. you are a pathetic idiot. The lamp is green.",
]
FINE = [
    None, "", "   ", "good morning", "stupid question, but how do i rotate this key", "the parasite in the pond feeds on snails", "rats and maggots are useful for the compost", "this damn parser is ugly, useless and slow",
    "i felt like an idiot for an hour until i saw the typo", 'moderators removed a note that said "you are a stupid rat"', 'why is "filthy clown" not caught by my word filter', "please do not post words like idiot in the support channel",
    "Bob called me a moron yesterday so i muted that account", "the watchdog had to kill the stuck relay process again", "our museum shows nude statues from the old harbour", "naked mole rats live in large colonies", "i hate mondays and i hate yaml",
    "the sex of the chick is known after hatching", "breast cancer screening is free this month", "mierda de tiempo, llueve otra vez", "so ein Mist, der Filter klemmt wieder", "my neighbours are Blues and they fixed our roof",
    "cocktails at the Essexville assessment centre", "that climb nearly killed me but the view is worth it", "master and slave replicas need new names", 'this account wrote "you are a disgusting moron", please review', "you are not a bad person", "{broken json", "*" * 2000,
]


@pytest.mark.parametrize("text", CASES)
def test_cases(text):
    assert GRAMMAR.score(text)[0] >= 0.5, GRAMMAR.lexicon.rewrite(abuse.plain(text))


@pytest.mark.parametrize("text", FINE)
def test_fine(text):
    assert GRAMMAR.score(text)[0] < 0.5, GRAMMAR.clauses(text)


def test_no_word_scores_by_itself():
    for w in [*abuse.INSULTS, *abuse.EXPLICIT, *abuse.HARM, *abuse.ADJECTIVES]:
        assert GRAMMAR.score(f"the {w} again")[0] < 0.5


def test_scores_in_spark(spark):
    df = spark.createDataFrame([(1, "you are a stupid rat", 9.0), (2, None, 9.0), (3, "fine", 9.0), (1, "you are a stupid rat", 9.0), (4, "calm lamps " * 50_000 + "you are a stupid rat", 9.0)], "id bigint, content string, abuse_score double")
    got = sorted((r["id"], r["abuse_score"] >= 0.5, r["abuse_kind"]) for r in abuse.score_texts(df, "content").collect())
    assert [g[:2] for g in got] == [(1, True), (1, True), (2, False), (3, False), (4, True)] and got[2][2] is None and got[0][2] == "insult"
    assert abuse.score_texts(df.limit(0), "content").count() == 0


def test_weights_follow_the_verdicts(spark):
    texts = spark.createDataFrame([(f"a{i}", "you are a stupid rat") for i in range(60)] + [(f"b{i}", "i know your street") for i in range(60)], "id string, content string")
    votes = spark.createDataFrame([(f"a{i}", 1) for i in range(60)] + [(f"b{i}", 0) for i in range(60)] + [("a1", None), (None, 1), ("gone", 1)], "id string, is_abusive int")
    w = abuse.fit_weights(texts, votes, [])
    assert w["you_are"] > 0.95 and w["know_street"] < 0.2
    assert abuse.fit_weights(texts, votes.limit(0), []) == {}
    lexicon = spark.createDataFrame([("zorgle", "insult"), (None, "x")], "term string, category string")
    assert abuse.Grammar(abuse.Lexicon(abuse.lexicon_terms(lexicon))).score("you are a zorgle")[0] >= 0.5
    assert F is not None


def test_agreement_with_held_out_verdicts(spark):
    """Weights fitted on half of the stored verdicts, by a hash of the event, agree with the other half, which are themselves
    partly wrong, and no less than the prior does."""
    d = "/root/testdata/sf0.1"
    labels, events = spark.read.parquet(f"{d}/abuse_labels.parquet"), spark.read.parquet(f"{d}/seed_events.parquet")
    terms = abuse.lexicon_terms(spark.read.parquet(f"{d}/abuse_lexicon.parquet"))
    half = F.pmod(F.xxhash64("id"), F.lit(2))
    weights = abuse.fit_weights(events.select("id", "content"), labels.filter(half == 0), terms)
    votes = labels.filter("is_abusive is not null").filter(half == 1).groupBy("id").agg(F.avg("is_abusive").alias("y")).filter("y in (0, 1)")
    ev = events.filter("content is not null").join(votes, "id").dropDuplicates(["id"]).select("id", "content", "y").cache()
    right = []
    for w in (None, weights):
        s = abuse.score_texts(ev, "content", terms, w)
        r = s.agg(F.count_if((F.col("abuse_score") >= 0.5) & (F.col("y") == 1)).alias("tp"), F.count_if(F.col("abuse_score") >= 0.5).alias("p"), F.count_if(F.col("y") == 1).alias("t")).first()
        right.append((r["tp"] / r["p"], r["tp"] / r["t"], r["p"]))
    (_, before, fewer), (precision, recall, more) = right
    assert precision > 0.9 and recall > 0.8 and recall > before and more > fewer
    ev.unpersist()


THREATENING = ["I'm gonna beat the crap out of you", "I am going to put a bullet in your head", "your kind makes me sick", "Go back to your country, filthy immigrants", "nobody would cry at your funeral", "You're such a bonehead",
               "they are going to strangle him", "you people disgust me", "You stupid wanker", "we will beat you until you beg", "What a disgusting pig he is"]
HARMLESS = ["We will run your tests tomorrow.", "They will hit your inbox by noon.", "We will beat them in the final on Saturday.", "We will shoot your wedding in June.", "we will crush them at chess", "I will cut you a slice of cake.",
            "Where they steal bases they always steal", "You are pig farmers, right?", "the relay should be killed and restarted", "I am such an idiot", "He said \"you are an idiot\" and left", "you are not an idiot", "This cache should be wiped"]


@pytest.mark.parametrize("text", THREATENING)
def test_clauses_of_no_stored_table(text):
    assert GRAMMAR.score(text)[0] >= 0.5, GRAMMAR.lexicon.rewrite(abuse.plain(text))


@pytest.mark.parametrize("text", HARMLESS)
def test_everyday_senses(text):
    assert GRAMMAR.score(text)[0] < 0.5, [(abuse.components(*c), GRAMMAR.weigh(*c)) for c in GRAMMAR.clauses(text)]


def test_held_out_templates():
    """Clauses put together here from other targets, harms and contexts than any stored text has."""
    cases = [f"{a} {h} {t}" for a in ("we will", "I'm going to", "somebody should", "they want to") for h, t in (("murder", "you"), ("strangle", "your mother"), ("break", "both of your arms"), ("burn", "down your house"))]
    cases += [f"{p} {n}{e}" for p in ("you are nothing but a", "shut up you worthless", "nobody asked you, vile") for n in ("cockroach", "scumbag", "leech") for e in ("", "!", ", Tom", " and a liar")]
    assert [c for c in cases if GRAMMAR.score(c)[0] < 0.5] == []
    taken_back = [f'the reporter wrote that "{c}" was sent to her' for c in cases] + [f'"{c}", he said' for c in cases]
    assert [c for c in taken_back if GRAMMAR.score(c)[0] >= 0.5] == []


def test_context_reaches_over_a_whole_sentence():
    """A report far before or after a quoted clause takes it back, whatever lies between; a sentence's end ends it."""
    filler = "calm lamp river " * 5000
    assert GRAMMAR.score(f'she wrote {filler} "you are a stupid rat" {filler}')[0] < 0.5
    assert GRAMMAR.score(f'"you are a stupid rat" {filler} she wrote')[0] < 0.5
    assert GRAMMAR.score(f"she wrote {filler}. you are a stupid rat")[0] >= 0.5


def test_verdicts_decide_doubtful_clauses():
    idiom = "even your own parents regret you"
    assert GRAMMAR.score(idiom)[0] < 0.5
    fitted = abuse._fitted([(["idiom", "regret"], 12, 11.0), (["you_are"], 40, 39.0), (["coming_for"], 30, 1.0)])
    g = abuse.Grammar(weights=fitted)
    assert g.score(idiom)[0] >= 0.5 and g.score("you are a rat")[0] >= 0.5 and g.score("we are coming for you")[0] < 0.5
    assert abuse._fitted([]) == {}


def brute_matches(expression, words):
    """All (begin, end) spans of an expression of the small notation, by a regular expression over marked words."""
    body = re.sub(r"\{(\d+),(\d+)\}", r"{\1,\2}", expression)
    out = []
    for p in re.findall(r"[()|?*]|\{\d+,\d+\}|[^\s()|?*{}]+", body):
        out.append("(?:" if p == "(" else p if p in ")|?*" or p[0] == "{" else r"(?:<[^|>]+>)" if p == "." else f"(?:<{re.escape(p)}>)")
    whole = re.compile("".join(out))
    return {j for i in range(len(words)) for j in range(i, len(words) + 1) if whole.fullmatch("".join(f"<{w}>" for w in words[i:j]))}


@pytest.mark.parametrize("expression", ["a b", "a ( b | c ) * d", "a . {1,3} b", "a b ? ( c d ) {0,2} a", "( a | b b ) c"])
def test_machine_against_brute_force(expression):
    rng = random.Random(expression)
    m = Machine({})
    m.add(expression, 0)
    c = Composed(m, {"R_"}, set(), {"not"}, {"x"}, {"i"}, {"am"})
    for _ in range(200):
        words = rng.choices("abcde", k=rng.randint(0, 12))
        assert bool(c.read(words)) == bool(brute_matches(expression, words)), (expression, words)


def test_table_may_begin_anew(monkeypatch):
    monkeypatch.setattr(automata, "MOST_STATES", 5)
    g = abuse.Grammar()
    assert all(g.score(t)[0] >= 0.5 for t in CASES) and all(g.score(t)[0] < 0.5 for t in FINE)
