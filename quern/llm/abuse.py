"""Abusive, hateful, threatening and sexually explicit texts.

A weighted finite-state grammar, composed of transducers run one after another:

1. characters: case, width, accents, look-alike letters, hidden characters, digits for letters, letters set apart,
   drawn out or starred are rewritten to plain words;
2. words: each word is rewritten to its class (``I_`` insult, ``S_`` word built like one, ``A_`` insulting adjective,
   ``G_`` harm done to persons only, ``K_`` killing, ``V_`` harm that may be harmless, ``B_`` body part, ``X_`` explicit,
   ``x_`` suggestive, ``R_`` reporting verb), or stays as it is;
3. clauses: insult, threat, hate and sexual offer, each built of smaller machines (target, insulting noun phrase, agent
   and will, harm, body), composed with the machine of negation, self-address and reported speech (``automata``).

Only whole clauses score, never a word by itself. A clause has components, such as ``will``, ``grave`` and ``person``, and
its context is one more; its score is the logistic of their summed weights. Weights start from a prior and are fitted on
a bounded sample of reviewers' verdicts (``fit_weights``): clauses that are doubtful by themselves, such as idioms, count
only where reviewers bear them out, and those that reviewers reject stop counting.
"""

from __future__ import annotations

import functools
import json
import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.automata import NEGATED, PLAIN, QUOTE, REPORTED, SELF, Composed, Machine

# -- word classes: our own lists; the stored lexicon is added at run time --------------------------------------------
INSULTS = """idiot moron imbecile scumbag loser clown parasite pig rat cretin bastard maggot leech weasel halfwit dimwit
dipshit bitch asshole dumbass wretch creep traitor vermin cockroach trash garbage filth scum whore slut cunt wanker
twat prick jerk fool retard freak coward liar pervert subhuman animal dickhead motherfucker fucker shithead douchebag
swine snake toad slug worm dunce simpleton numbskull nitwit lowlife degenerate vollpfosten sheep dog cow hag ape monkey pest
idiota imbecil estupido estupida inutil gilipollas cabron pendejo basura escoria payaso tonto mierda puta puto rata asqueroso
idioten trottel versager arschloch abschaum drecksack wichser hurensohn dummkopf schwein vollidiot missgeburt penner mistkerl ratte
otario babaca lixo burro palhaco merda cretino vagabundo canalha corno verme
connard connasse salaud dechet abruti cretin imbecile ordure debile salope encule idiote minable raclure pourriture
baka""".split()
ADJECTIVES = """worthless pathetic stupid disgusting filthy brainless spineless ugly vile rotten shitty fucking braindead useless
dumb idiotic moronic miserable dirty gutless lousy damn goddamn bloody stinking sick nasty ignorant repulsive mindless
wertloser wertlose dummer dumme ekelhafter widerlicher hasslicher nojento nojenta imundo estupido inutil asqueroso
asquerosa sucio fini gros pauvre sinnloser""".split()
HARM = """kill killed kills hang hanged hung burn burned burnt beat beaten beats break breaks smash smashed stab stabbed shoot shot
hit hits strangle strangled crush crushed drown drowned slit cut choke choked rape raped murder murdered bury buried gut skin
punch kick bash destroy hurt lynch lynched exterminate exterminated gas gassed shatter snap rip tear wipe wiped slaughter
slaughtered execute executed drag dragged run""".split()
#: of these the ones that are done to persons only, and those of killing; the rest may be harmless
GRAVE = """hang hanged hung strangle strangled stab stabbed rape raped murder murdered lynch lynched behead beheaded exterminate exterminated
slaughter slaughtered gas gassed slit gut skin drown drowned choke choked""".split()
KILLING = "kill killed kills".split()
#: endings of made-up insults, as in bonehead
BUILT = re.compile(r"[a-z]{3,}(?:head|face|brain|brains|wit|wits|bag|bags|hole|holes|tard|tards|sucker|suckers|stain|heads|faces|wipe|weasel)")
BODY = "rib ribs neck necks leg legs arm arms jaw jaws tooth teeth finger fingers skull face head knees kneecaps throat bones nose eyes spine hands".split()
EXPLICIT = """porn porno xxx nudes blowjob blowjobs cock dick pussy tits boobs horny cum cumming orgasm hentai milf milfs camgirl camgirls handjob
dildo anal creampie gangbang threesome onlyfans fuck fucked boner erection masturbate masturbating clit nsfw deepthroat
sexo sexe peladas pelada nuas desnudas desnuda nackte nackt nues nue polla tetas follar porra buceta gostosas ficken""".split()
SUGGESTIVE = """naked nude sex sexy bare thighs thigh moaned moaning moan lick licking suck sucking strip stripping breasts nipples
panties lingerie explicit uncensored adults erotic topless cam webcam bed wet hard legs body girls women housewives hot
live gratis gratuit kostenlos vivo direct escort""".split()
FRAMES = """said says say wrote writes called calls call quoted quotes quote removed reported reports report filter caught muted flagged
banned blocked word words term phrase slur slurs moderators moderator moderation example means translation dictionary lyrics
article headline film novel typed complained overheard genannt nannte sagte schrieb llamo dijo chamou disse appele dit traite""".split()
NEGATIONS = "not never no nobody nor isnt arent wasnt dont doesnt didnt nicht kein keine nao pas jamais ningun nunca nie".split()

# fixed values: letters that look alike, digits and signs that stand for letters
LOOKALIKE = str.maketrans("аеорсхуіјѕԁһӏьвкмтнԛԝαεοριυνκτωηƨßøłđæ", "aeopcxyijsdhlbbkmthqwaeopiuvktwnssolda")
LEET = [str.maketrans("0134578@$!|", f"o{one}eastbasi{one}") for one in "il"]
HIDDEN = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠎​-‏‪-‮⁠-⁯︀-️﻿]")
_LINK = re.compile(r"\b(?:https?|wss?)://\S+|\bnostr:\S+")
_APART = re.compile(r"(?<![\w*#@$'’])[^\W\d_](?:(?: |[.\-_~·] ?)[^\W_]){2,}(?![\w*#@$'’])")
_TOKEN = re.compile(r"[^\W_][\w@$*!|'’.\-·~#+]*[\w*]|[^\W_]|[@$*][\w@$*]+|[\"“”„«»]|[.!?…;:\n]+|,|[^\w\s]")
_INNER = re.compile(r"[\W_]+")
_RUN = re.compile(r"(.)\1+")
_JOINERS = frozenset("*_·@~#")


def plain(text: str) -> str:
    """Lower case, composed letters, no accents, no hidden characters, no links; look-alikes to Latin."""
    if not text.isascii():
        text = HIDDEN.sub("", text)
        text = unicodedata.normalize("NFKD", text)
        text = "".join(c for c in text if not unicodedata.combining(c)).lower().translate(LOOKALIKE)
    else:
        text = text.lower()
    return _LINK.sub(" ", text) if ":" in text else text


def _strings(value) -> Iterator[str]:
    if isinstance(value, str):
        yield value
    elif isinstance(value, (dict, list)):
        for v in value.values() if isinstance(value, dict) else value:
            yield from _strings(v)


def unpack(text: str) -> str:
    """The strings of a text that is a JSON object, one a line; any other text as it is."""
    if text.lstrip()[:1] == "{":
        try:
            return "\n".join(_strings(json.loads(text)))
        except (ValueError, RecursionError):
            return re.sub(r"\\u([0-9a-fA-F]{4})", lambda m: chr(int(m[1], 16)), text).replace('"', "\n")
    return text


def _squeeze(word: str) -> str:
    return _RUN.sub(r"\1", word)


class Lexicon:
    """Words to classes, with the disguises a word may wear. Words outside it are kept."""

    def __init__(self, extra: list[tuple[str, str]] | None = None):
        self.of: dict[str, str] = {}
        for mark, words in (("R_", FRAMES), ("x_", SUGGESTIVE), ("B_", BODY), ("V_", HARM), ("G_", GRAVE), ("K_", KILLING), ("X_", EXPLICIT), ("A_", ADJECTIVES), ("I_", INSULTS)):
            for w in words:
                self.of[w] = mark
        # words that clauses name as such and that are worth unmasking
        named = "human gueule fresse boca callate verrecke verreck morrer muere mueras creature alive yourself ditch shut halt cala creva crever kys spread you your are should nobody".split()
        own = {"insult": "I_", "sexual": "X_", "hate": "I_"}
        for term, category in extra or []:
            w = plain(term).strip()
            if " " not in w and w not in self.of and w not in named and category in own:
                self.of[w] = own[category]
        for w in [w for w, m in self.of.items() if m == "I_" and len(w) > 2]:
            for plural in ((w[:-1] + "ies",) if w.endswith("y") else (w + "es",) if w[-1] in "shx" else (w + "s", w + "en")):
                self.of.setdefault(plural, "I_")
        self.words = set(self.of) | set(named)
        rank = {"I_": 0, "A_": 1, "X_": 2, "V_": 3, "G_": 3, "K_": 3, "x_": 4, "": 5}
        worth = sorted((w for w in self.words if self.of.get(w, "") in rank), key=lambda w: (rank[self.of.get(w, "")], w), reverse=True)
        self.squeezed: dict[str, str] = {}
        self.masks: dict[tuple, str] = {}
        for w in worth:  # of several words with one disguise the first by rank is left
            if len(w) >= 4 or self.of.get(w) in ("I_", "X_"):
                self.squeezed[_squeeze(w)] = w
            if len(w) >= 3:
                self.masks[w[0], w[-1], len(w)] = self.masks[w[0], "*", len(w)] = w
        self.by_size: dict[int, list[str]] = {}
        for w in reversed(worth):
            self.by_size.setdefault(len(w), []).append(w)

    def undo(self, raw: str) -> str | None:
        """The lexicon word that a disguised token stands for."""
        if "*" in raw or "#" in raw:
            bare = raw.strip(".,!?'")
            stars = bare.count("*") + bare.count("#")
            if stars >= 2 and bare[:1].isalpha() and (w := self.masks.get((bare[0], bare[-1].replace("#", "*"), len(bare)))):
                return w
            if stars and len(bare) >= 3 and bare[0].isalpha() and bare.count("*") + bare.count("#") < len(bare) - 1:
                shape = re.compile("".join("." if c in "*#" else re.escape(c) for c in bare))
                if w := next((w for w in self.by_size.get(len(bare), ()) if shape.fullmatch(w)), None):
                    return w
        bare = _INNER.sub("", raw)
        if bare in self.words:
            return bare
        for t in dict.fromkeys((raw, raw.translate(LEET[0]), raw.translate(LEET[1]))):
            t = _INNER.sub("", t)
            if t in self.words:
                return t
            if (w := self.squeezed.get(_squeeze(t))) and len(t) >= len(w) and len(t) > 3:
                return w
        return None

    def rewrite(self, text: str) -> list[str]:
        """The words of a plain text as classes, ``|`` between sentences, ``,`` and ``"`` kept."""
        if _APART.search(text):
            text = _APART.sub(self._join, text)
        out: list[str] = []
        of, words = self.of, self.words
        for raw in _TOKEN.findall(text):
            first = raw[0]
            if raw.isalpha():
                if raw in words:
                    out.append(of.get(raw, raw))
                    continue
                if len(raw) > 3:
                    w = self.squeezed.get(_squeeze(raw))
                    if w and w != raw and len(raw) >= len(w):
                        out.append(of.get(w, w))
                        continue
                    if BUILT.fullmatch(raw):
                        out.append("S_")
                        continue
                out.append(raw)
            elif first in ".!?…;:\n":
                out.append("|")
            elif first == ",":
                out.append(",")
            elif first in '"“”„«»':
                out.append('"')
            elif first.isalnum() or first in "*@$":
                if raw.isdigit():
                    out.append("9")
                elif w := self.undo(raw):
                    out.append(of.get(w, w))
                else:
                    parts = [x for x in _INNER.split(raw) if x]
                    if len(parts) > 1 and (not _JOINERS.isdisjoint(raw) or "." not in raw and min(map(len, parts)) <= 2):
                        parts = ["".join(parts)]  # a sign put into an unknown word
                    out += [of.get(x, x) for x in parts]
                    if "." in raw or "!" in raw:
                        out.append("|")
        return out

    def _join(self, m: re.Match) -> str:
        """Letters set apart, as the words they spell; they stay apart if they spell none."""
        whole = re.sub(r"[\W_]+", "", m[0])
        for t in dict.fromkeys((whole, whole.translate(LEET[0]), whole.translate(LEET[1]))):
            # cut[i]: the fewest words that spell the first i letters
            cut: list[list[str] | None] = [[]] + [None] * len(t)
            for i in range(1, len(t) + 1):
                for k in range(max(0, i - 16), i):
                    w = t[k:i]
                    if cut[k] is not None and (w in self.words and len(w) > 2 or w in ("a", "i", "u", "is", "are", "you")):
                        if cut[i] is None or len(cut[k]) + 1 < len(cut[i]):
                            cut[i] = [*cut[k], w]
            if cut[-1] and max(map(len, cut[-1])) > 2:
                return " ".join(cut[-1]) + " "
        return whole + " " if len(whole) > 3 else m[0]


# -- clauses ---------------------------------------------------------------------------------------------------------
NAMED = {
    "you": "(you | u | ya | youre | ur | yall | they | theyre)",
    "are": "(are | r | re | were)",
    "det": "(a | an | the | such | just | total | complete | absolute | real | little | another | one | of | those | these | ein | eine | du | un | una | um | uma | une | seu | sua | pedazo | espece | de | tu | sale | bande | verdammter | so)",
    "ai": "<det> * (A_ | I_ | V_ | K_ | G_) * I_",
    # what ends a noun phrase, so that a compound ("pig farmers") is no insult
    "stop": "($ | , | QUOTE | and | or | but | who | that | which | like | with | i | so | huh | lol | already | you | in | of | to | for | on | at | from | because | as | here | every | all | de | A_ | I_ | R_ | 9)",
    "agent": "(i | we | somebody | someone | they | he | she)",
    "will": "(<agent> (will | shall | should | would | ll | gonna | must | (am | are | is) going to | want to | wanna | can | am gonna | are gonna) | (im | were | theyre) (gonna | going to) | ill)",
    "harm": "(G_ | K_ | V_)",
    "person": "(you | u | ya | yall | them | him | her | your (wife | husband | mother | mom | son | daughter | dog | parents | friends))",
    "kin": "(your | ur | their | his | her) . {0,2} (house | home | kids | children | family | car)",
    "poss": "(your | yours | ur | his | her | their | those | these)",
    "should": "(should | must | ought to | needs to | need to | deserve to | deserves to | has to | have to) all ? (be | get)",
    "folk": "(you | u | they | people like you | your kind | you people)",
    "neg": "(NEGATIONS)",
    "noone": "(nobody | no one | noone)",
}
NAMED["stop"] = NAMED["stop"].replace("QUOTE", QUOTE)
NAMED["neg"] = NAMED["neg"].replace("NEGATIONS", " | ".join(NEGATIONS))

#: (category, components joined by colons, expression)
CLAUSES: list[tuple[str, str, str]] = [
    # insults
    ("insult", "you_are", "<you> <are> ? (all | really | truly | always | nothing but | nothing more than) ? <ai> <stop>"),
    ("insult", "you_are:compound", "<you> <are> ? (all | really | truly | always | nothing but | nothing more than) ? <ai>"),
    ("insult", "you_are:built", "<you> <are> ? (such | really | truly | nothing but) ? (a | an) (A_ | .) ? S_ <stop>"),
    ("insult", "you_are:built", "<you> (A_ | stupid | dumb | I_) S_ <stop>"),
    ("insult", "you_adj", "<you> (are | re) (so | all | really | just | too) * A_ ($ | , | and | A_)"),
    ("insult", "what_a", "what <ai> (you | they | he | she) (are | is)"),
    ("insult", "only_a", "only <ai> (would | could | posts | writes)"),
    ("insult", "vocative", "(shut up | nobody asked you | no one asked you | go (cry | away | home | die) . {0,3} | get lost | get out | block this | kill yourself | drop dead | hits you | <harm> you | hey | listen | look at you | screw you | X_ you | X_ off) , ? you ? <ai> <stop>"),
    ("insult", "still_a", "still <ai> (i see | as ever | huh | lol)"),
    ("insult", "raised_a", "(mother | mom | mum | father | parents | family) (raised | bore | made | birthed | has raised) <ai> <stop>"),
    ("insult", "as_adj_as", "(being | be | are | is) as (A_ | I_) as . {1,3}"),
    ("insult", "nothing_but", "(is | are) (nothing but | nothing more than | just | only | such | a complete | a total | an absolute) <ai> <stop>"),
    ("insult", "name_is", "^ . is <ai> ($ | , | and)"),
    ("insult", "bare", "^ (A_ | I_) (A_ | I_) * I_ $"),
    ("insult", "that_is_all", "(A_ | I_) I_ $ that is all you are"),
    ("insult", "this_ai", "(block | ban | mute | report | ignore) this A_ * I_"),
    ("insult", "creature", "A_ creature"),
    ("insult", "waste", "you are a ? (waste of | disgrace | joke | beneath | less than | not even)"),
    ("insult", "everyone_hates", "(everyone | everybody | nobody) (hates | likes | loves | despises | wants) you ($ | ,)"),
    # idioms: doubtful until reviewers bear them out
    ("insult", "idiom:threw_up", "you (look | smell | sound) like (something | what | the thing) . {0,4} (threw | vomited | dragged | shat | puked | spat | coughed)"),
    ("insult", "idiom:drain", "best part of you ran down"),
    ("insult", "idiom:regret", "(parents | mother | father | family | mom | mum | kids | children | friends) . {0,2} (regret | regrets | hate | hates | despise | ashamed of | are ashamed of) (you | having you)"),
    ("insult", "idiom:no_wonder", "no wonder . {1,5} (left | leaves | hates | dumped) (, ? look at you | you $ | you , | $)"),
    # insults elsewhere
    ("insult", "de_bist", "(du bist | ihr seid | sie sind) . {0,3} (A_ | I_)"),
    ("insult", "de_maul", "halt (die | deine | dein) (fresse | maul | klappe)"), ("insult", "de_maul", "(halte | haltet) (die | deine | dein | eure) (fresse | maul | klappe)"),
    ("insult", "de_du", "(du | ihr) A_ * I_"),
    ("insult", "es_eres", "eres <ai>"), ("insult", "es_eres", "eres . {0,3} A_"), ("insult", "es_callate", "callate"), ("insult", "es_pedazo", "pedazo de (I_ | A_)"),
    ("insult", "pt_voce", "voce e . {0,2} (I_ | A_)"), ("insult", "pt_cala", "cala a boca"), ("insult", "pt_seu", "(seu | sua) A_ * I_"),
    ("insult", "fr_tu", "(tu es | t es | vous etes) . {0,3} (I_ | A_)"), ("insult", "fr_gueule", "(ferme | fermez) (ta | vos | votre) gueule"), ("insult", "fr_espece", "espece de A_ * I_"),
    # threats and wishes of harm: agent and will, harm, target
    ("threat", "will:grave", "<will> (find . {1,6} and ?) ? . {0,3} (G_ | K_) . {0,2} <person>"),
    ("threat", "mild", "<will> (find . {1,6} and ?) ? . {0,2} V_ <person>"),
    ("threat", "mild:hard", "<will> . {0,2} V_ <person> (until | so hard | up | dead | bloody | senseless | unconscious | to death | to pieces | , you | with a (bat | knife | hammer | brick))"),
    ("threat", "will:rough:body", "<will> (find . {1,6} and ?) ? . {0,3} <harm> . {0,5} <poss> . {0,2} B_"),
    ("threat", "will:rough:kin", "<will> (find . {1,6} and ?) ? . {0,3} <harm> (down ?) <kin>"),
    ("threat", "out_of", "(V_ | knock | smack | slap | punch | kick) the . {1,2} out of <person>"),
    ("threat", "bullet", "(put | fire | have) (a | two | some) (bullet | bullets | knife | blade) (in | into | through | between) <poss>"),
    ("threat", "should:grave", "<should> G_"), ("threat", "should:unaimed", "<should> (V_ | K_ | shot)"), ("threat", "should:rough:folk", "<folk> <should> (V_ | K_ | shot)"),
    ("threat", "deserve:rough:folk", "<folk> all ? (deserve | deserves) to (be V_ | be K_ | die | suffer | rot | burn | bleed | V_ | K_)"), ("threat", "deserve:grave", "deserves ? to (be G_ | be K_ | die | suffer | rot | bleed)"),
    ("threat", "put_down", "(should | must | needs to | need to | deserve to) all ? be put down"),
    ("threat", "will:body", "<harm> (every one of | all | both | each of | off) ? <poss> . {0,2} B_"),
    ("threat", "will:kin", "<harm> <poss> . {0,2} (house | home | car | family)"),
    ("threat", "kill_self", "(<harm> | off | end) yourself"), ("threat", "kys", "kys"),
    ("threat", "find_you", "(i | we) (will | ll | shall | can | am going to | gonna) find (out ?) (where ?) you"),
    ("threat", "coming_for", "(we | i | they) (are | am | re | m) ? coming (for | after) (you | your)"),
    ("threat", "watch_back", "watch your back"), ("threat", "know_street", "i know (your | where you | which) (street | address | house | live | sleep | work | school | kids)"),
    ("threat", "hope_harm", "(hope | wish | pray) . {0,5} (<harm> you | you (die | <harm> | rot | suffer | crash | never wake) | <harm> your)"),
    ("threat", "ditch", "you (will | ll) ? (end up | land | wake up | finish) in (a | the) ditch"), ("threat", "keep_on", "(keep | carry on | go on) . {1,3} (and | or) you (will | ll) ? (end up | be | get | wake up) (in | dead | <harm> | hurt)"),
    ("threat", "never_wake", "never wake up"), ("threat", "no_breath", "<noone> would (miss | notice | care) . {0,3} you ? . {0,2} stopped breathing"), ("threat", "no_breath", "(stop | quit) breathing"),
    ("threat", "unmissed", "<noone> would (miss you | (cry | mourn | come | care | weep) . {0,4} (funeral | grave | if you died))"),
    ("threat", "favour", "do (us all | everyone | the world | us | everybody) a (favour | favor) and (die | <harm> | never | jump | disappear | go | stop)"),
    ("threat", "go_die", "(go | just | please | hope you | you should | you will | gonna) and ? (die | rot)"), ("threat", "next_time", "next time i (see | meet | find | catch) . {1,2} i (will | ll) <harm>"),
    ("threat", "es_mueras", "(ojala | espero que) te mueras"), ("threat", "es_muere", "muerete"), ("threat", "es_matar", "(te voy a | vamos a | voy a) matar"),
    ("threat", "pt_morrer", "(vai | va | deveria | tomara que) morrer"), ("threat", "pt_morra", "(tomara que voce ? | que voce) morra"), ("threat", "pt_matar", "vou te matar"),
    ("threat", "de_verreck", "(verrecke | verreck)"), ("threat", "de_stirb", "stirb"), ("threat", "de_umbringen", "(dich | euch) (umbringen | schlagen)"),
    ("threat", "fr_creve", "(va | allez) ? (creve | crever | crevez)"), ("threat", "fr_tuer", "(te | vous | vais te) tuer"),
    # hate against groups
    ("hate", "without", "(world | place | town | country | planet | land | web | city | street | streets | relay) (would | will | could) be a ? (cleaner | better | safer | nicer) place ? without"),
    ("hate", "not_human", "((are | is | were) <neg> | arent | isnt | <neg>) (even | really | fully) ? human"),
    ("hate", "no_rights", "(do <neg> | <neg> | don t) deserve any ? (rights | to vote | mercy | respect | to live)"),
    ("hate", "send_back", "(send | ship | deport | throw | drive | <harm>) (every one of | all of | all | every) ? (the | these | those | them) ? . {0,2} (back | out | home) (across | over | to | where | of)"),
    ("hate", "go_back", "(go | get | crawl) back (to your (country | own country | hole | homeland) | where you came from)"),
    ("hate", "driven_out", "(should | must | need to | have to | ought to) all ? be (driven | thrown | kicked | wiped | rounded | kept) (out | off | up | away)"),
    ("hate", "all_are", "(all | every | those | these | most) (of the | of these | the) ? . (are | is) <ai> <stop>"),
    ("hate", "they_steal", "they (all | only) (steal | lie | cheat | stink | smell | rob)"), ("hate", "they_steal:twice", "they (all | only) (steal | lie | cheat | stink | smell | rob) and (steal | lie | cheat | stink | smell | rob)"), ("hate", "breed_like", "(breed | multiply | spread | swarm) like (I_ | flies | rabbits | a disease | a plague | lice)"),
    ("hate", "your_kind", "(your kind | people like you | you people) (make me | makes me | disgust | disgusts | sicken | sickens | ruin | ruins | (do | does) <neg> belong | (are | is) <neg> (wanted | welcome))"),
    ("hate", "never_hire", "(<neg> | don t) ever ? (hire | trust | rent to | serve | marry | employ) . , ? they"),
    ("hate", "no_group", "^ <neg> . (here | allowed | wanted | in) . {0,2} they are <ai>"), ("hate", "defends", "(whoever | anyone | everyone | who) who ? (defends | helps | likes | supports | trusts) . (is | are) <ai>"),
    ("hate", "idiom:ruin", "(ruin | ruins | destroy | infest | poison) (every | our | the | this) (town | city | country | neighbourhood | street | land | village | nation)"),
    # sexual
    ("sexual", "spread", "spread (your | her | those | them) (B_ | x_)"),
    ("sexual", "offer", "(free | send | sending | sell | selling | buy | hot | watch | download | uncensored | explicit | x_ | live | my | your | her | his | want | those | real | amateur | le | em | en) (me | you | your | some | of | more | x_) * X_"),
    ("sexual", "more", "X_ . {0,4} (X_ | x_ | for you | waiting | now | free | tonight | me | you | her | him | dm)"),
    ("sexual", "would", "(would | wanna | want to | will | gonna | let me | going to) X_ (her | him | you | them | that)"),
    ("sexual", "dm_naked", "x_ x_ * (women | girls | housewives | men | boys | teens | x_) . {0,6} (tonight | dm | now | near you | click | free | live)"),
    ("sexual", "moaned", "x_ (while | as | and) (he | she | they | i) . {1,5} between (her | his | your | my) . {0,2} (x_ | B_)"),
    ("sexual", "lick", "(want to | wanna | will | would | let me | love to | going to) x_ . {0,5} (your | her | his) . {0,2} (x_ | X_ | B_)"),
    ("sexual", "want", "X_ . {0,4} want x_"), ("sexual", "live", "X_ . {0,3} x_ , (X_ | x_ | sexo | sexe)"), ("sexual", "tape", "X_ x_ (tape | video | videos | clip | cam | pics | movie | movies | show)"),
]
#: weights of components before verdicts are seen, in log-odds; a clause of one component has ``WEIGHT``
WEIGHT = 1.75
PRIOR = {
    "you_are:compound": -1.5, "compound": -3.25, "built": -0.75, "idiom": -1.5, "threw_up": 1.0, "drain": 1.0, "regret": 1.0, "no_wonder": 1.0, "ruin": 1.0,
    "will": 0.0, "should": 0.0, "deserve": 0.0, "grave": 2.0, "rough": 0.0, "mild": -1.0, "hard": 3.0, "body": 1.75, "kin": 1.75, "folk": 1.75, "unaimed": -1.5,
    "they_steal": -0.25, "twice": 2.0, "know_street": 0.75, "send_back": 0.75, "breed_like": 0.75,
}
CONTEXTS = {NEGATED: "negated", SELF: "self", REPORTED: "reported"}
#: what a context takes away
CONTEXT_PRIOR = -5.0
#: how far, in log-odds, a component may move from its prior: standard deviation of the belief
BELIEF = 2.0


def components(clause: int, tag: int) -> tuple[str, ...]:
    """The weighted parts of a matched clause: its own, and its context."""
    category, name, _ = CLAUSES[clause]
    taken = tag in CONTEXTS and (tag != SELF or category == "insult")  # one may insult oneself, but not threaten
    return (*name.split(":"), *([CONTEXTS[tag]] if taken else []))


def prior(component: str) -> float:
    return CONTEXT_PRIOR if component in CONTEXTS.values() else PRIOR.get(component, WEIGHT)


@functools.cache
def _machine() -> Machine:
    m = Machine(NAMED)
    for i, (_, _, expression) in enumerate(CLAUSES):
        m.add(expression, i)
    return m


class Grammar:
    def __init__(self, lexicon: Lexicon | None = None, weights: dict[str, float] | None = None):
        self.lexicon = lexicon or Lexicon()
        self.weights = {c: prior(c) for i in range(len(CLAUSES)) for t in (PLAIN, *CONTEXTS) for c in components(i, t)} | (weights or {})
        self.machine = Composed(
            _machine(), {"R_"}, {("words", "like"), ("word", "like"), ("terms", "like"), ("term", "like"), ("why", "is")}, {*NEGATIONS, "hardly"},
            set("a an the call say think saying calling that really".split()), set("i me my myself im".split()), set("felt feel am was look looked sound".split()))
        self.anchors = frozenset({"I_", "A_", "G_", "K_", "V_", "X_", "x_", "S_"} | {w for w in self.machine.m.words if len(w) > 3 and w not in _COMMON and w not in self.lexicon.of} | _RARE)

    def clauses(self, text: str | None) -> list[tuple[int, int]]:
        """(clause, context) of every matched clause; a null or blank text has none."""
        if not text:
            return []
        words = self.lexicon.rewrite(plain(unpack(text)))
        if self.anchors.isdisjoint(words):
            return []
        return sorted(self.machine.read(words))

    def weigh(self, clause: int, tag: int) -> float:
        return sum(self.weights[c] for c in components(clause, tag))

    def score(self, text: str | None) -> tuple[float, str | None]:
        """(0..1, category) of the heaviest clause; 0 and null where nothing matches."""
        best = max(((self.weigh(c, t), CLAUSES[c][0]) for c, t in self.clauses(text)), default=None)
        return (0.0, None) if best is None else (1 / (1 + math.exp(-best[0])), best[1])


#: words of clauses that no clause does without a rarer one
_COMMON = frozenset("such just total complete absolute real little another those these that which like with already they them were your their from because here every will shall would could must this when what have been some more free send live want real".split())
_RARE = frozenset("kys put should deserve back human drain hope find know miss favour favor ditch".split())


def lexicon_terms(lexicon: DataFrame) -> list[tuple[str, str]]:
    """(term, category) of a stored lexicon; a lexicon is a small fixed table and is read whole."""
    return sorted({(r[0], r[1]) for r in lexicon.select("term", "category").filter("term is not null and category is not null").collect()})


def fit_weights(texts: DataFrame, verdicts: DataFrame, terms: list[tuple[str, str]], most: int = 40_000) -> dict[str, float]:
    """Weights of the components, in log-odds, that best explain the reviewers' verdicts, each held near its prior.

    ``texts`` is (id, content), ``verdicts`` (id, is_abusive); at most ``most`` events with verdicts, those with the smallest
    id hash, are used (so few that they are broadcast: some 100 bytes each). Several verdicts on an event are averaged; null
    verdicts are left out. Without any matched clause nothing is fitted. An event has its heaviest clause by the prior; of
    each set of components the events and their verdicts are counted, and only these counts reach the driver."""
    votes = verdicts.filter("id is not null and is_abusive is not null").groupBy("id").agg(F.avg("is_abusive").alias("y"))
    votes = votes.orderBy(F.xxhash64("id"), "id").limit(most)
    rows = texts.filter("id is not null and content is not null").join(F.broadcast(votes), "id").groupBy("id").agg(F.max("content").alias("content"), F.max("y").alias("y"))
    lexicon = Lexicon(terms)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(lexicon)
        n: dict[str, int] = {}
        y: dict[str, float] = {}
        for b in batches:
            for text, label in zip(b.column("content").to_pylist(), b.column("y").to_pylist()):
                if found := grammar.clauses(text):
                    key = ":".join(components(*max(found, key=lambda ct: (grammar.weigh(*ct), ct))))
                    n[key] = n.get(key, 0) + 1
                    y[key] = y.get(key, 0.0) + label
        yield pa.RecordBatch.from_pydict({"parts": pa.array(list(n), pa.string()), "n": pa.array(list(n.values()), pa.int64()), "y": pa.array([y[k] for k in n], pa.float64())})

    # at most a row for each clause and context
    counts = rows.select("content", "y").mapInArrow(tally, "parts string, n bigint, y double").groupBy("parts").agg(F.sum("n").alias("n"), F.sum("y").alias("y")).collect()
    return _fitted([(r["parts"].split(":"), r["n"], r["y"]) for r in sorted(counts)])


def _fitted(counts: list[tuple[list[str], int, float]], turns: int = 50) -> dict[str, float]:
    """Logistic weights by Newton's method: (components, events, sum of verdicts) a row, a normal belief about the prior."""
    names = sorted({c for parts, _, _ in counts for c in parts})
    if not names:
        return {}
    x = np.array([[parts.count(c) for c in names] for parts, _, _ in counts], float)
    n, y = np.array([r[1] for r in counts], float), np.array([r[2] for r in counts], float)
    start = np.array([prior(c) for c in names])
    w = start.copy()
    for _ in range(turns):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (y - n * p) - (w - start) / BELIEF**2
        move = np.linalg.solve(x.T @ (x * (n * p * (1 - p))[:, None]) + np.eye(len(w)) / BELIEF**2, slope)
        w += move * min(1.0, 2.0 / max(1e-12, np.abs(move).max()))
        if np.abs(move).max() < 1e-6:
            break
    return dict(zip(names, map(float, w)))


def score_texts(df: DataFrame, text: str, terms: list[tuple[str, str]] | None = None, weights: dict[str, float] | None = None) -> DataFrame:
    """``df`` with ``abuse_score`` (0 to 1) and ``abuse_kind`` (null where nothing matched). Columns of these names are
    replaced. Null, empty and blank texts score 0; texts are read whole, whatever their length; rows stay one for one."""
    rest = [c for c in df.columns if c not in ("abuse_score", "abuse_kind")]
    lexicon = Lexicon(terms)
    grammars: list[Grammar] = []  # one a worker, its table filled by all batches

    @F.pandas_udf("score double, kind string")
    def run(texts):
        import pandas as pd

        grammar = grammars[0] if grammars else Grammar(lexicon, weights)
        grammars[:] = [grammar]
        memo: dict[str, tuple[float, str | None]] = {}
        out = []
        for t in texts:
            key = t if isinstance(t, str) else ""
            if key not in memo:
                memo[key] = grammar.score(key)
            out.append(memo[key])
        return pd.DataFrame(out, columns=["score", "kind"])

    return df.select(*rest, run(F.col(text)).alias("_abuse")).select(*rest, F.col("_abuse.score").alias("abuse_score"), F.col("_abuse.kind").alias("abuse_kind"))
