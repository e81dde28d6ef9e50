"""An answerer that declines: word classes found by an Aho-Corasick automaton, and where they must stand in a sentence.

A refusal is told by its structure, not by its words alone: the answerer speaks of itself, says that it can not, may not or
will not, and names something that answerers do (answer, read, help, process). "I was never told" has no such act, "the
council cannot pay" no answerer. Words in quotations are another's.
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick

from pagemill.llm.folding import fold_word

#: Words and phrases of each class, folded, for English, German, French, Spanish, Italian and Portuguese.
CLASSES = {
    "self": "i me my myself / ich mir mich mein meine meinen meiner meinem / je j me m moi mon ma mes / yo me mi mis puedo tengo veo prefiero soy estoy logro consigo / io mi mio mia miei posso ho vedo sono riesco / eu me meu minha posso tenho vejo sou consigo",
    "not": "not no none nothing never t cannot without nor / nicht kein keine keinen keinem keiner nichts nie / ne n pas aucun aucune rien jamais / no ningun ninguno ninguna nada nunca / non nessun nessuna niente / nao nenhum nenhuma",
    "able": "can could couldn cannot able may allowed permitted possible way appropriate comfortable capable position will ll won rather prefer supposed authorised authorized"
    " / kann konnte darf moglich lage imstande fahig mochte will werde befugt / peux puis pourrais mesure capable possible autorise autorisee souhaite veux prefere vais"
    " / puedo podria capaz posible condiciones prefiero quiero deseo logro consigo voy / posso potrei possibile grado riesco preferisco / posso possivel capaz consigo prefiro",
    "unable": "unable impossible incapable / unmoglich ausserstande unfahig / impossible incapable / imposible incapaz / impossibile incapace / impossivel",
    "decline": "decline refuse abstain refrain / weigere lehne enthalte verzichte / refuse abstiens decline / abstengo niego declino rehuso / rifiuto astengo declino / recuso abstenho",
    "act": "answer answering respond responding reply replying help helping assist assisting comment commenting discuss discussing share sharing provide providing give giving tell telling"
    " reveal disclose read reading open opening process processing determine determining transcribe transcribing extract extracting verify interpret describe summarise"
    " summarize translate comply advise opine analyse analyze response"
    " / antworten beantworten antwort auskunft helfen sagen geben lesen erkennen auswerten bearbeiten verarbeiten offnen aussern kommentieren mitteilen weitergeben feststellen ubersetzen zusammenfassen abschreiben"
    " / repondre reponse aider dire lire traiter commenter fournir donner partager transcrire ouvrir determiner communiquer divulguer analyser"
    " / responder respuesta contestar ayudar decir leer procesar comentar opinar proporcionar dar compartir transcribir abrir determinar revelar analizar"
    " / rispondere risposta aiutare dire leggere elaborare commentare fornire dare condividere trascrivere aprire / responder resposta ajudar dizer ler processar comentar fornecer transcrever abrir",
    "look": "see seeing view viewing access / sehen sehe / voir vois / ver veo / vedere vedo / vejo",
    "hold": "have has had / habe hat / ai / tengo / ho / tenho",
    "object": "access file attachment document page image scan picture / zugriff zugang datei anhang dokument seite bild / acces fichier piece document page image / acceso archivo fichero documento pagina imagen / accesso documento pagina / acesso arquivo documento",
    "rules": "guidelines guideline policy policies instructions rules / vorgaben richtlinien regeln anweisungen / regles consignes directives instructions / normas reglas directrices politicas instrucciones / regole istruzioni / regras diretrizes instrucoes",
    "bar": "keep keeps prevent prevents forbid forbids prohibit prohibits stop stops / verbieten untersagen hindern verhindern / empechent interdisent / impiden prohiben / impediscono vietano / impedem proibem",
    "beyond": "beyond outside exceeds / ausserhalb jenseits ubersteigt / dela depasse hors / fuera alla excede / oltre fuori / alem",
    "do": "do does capabilities abilities scope remit competence / kann darf konnen zustandigkeit / fais peux capacites competences / hago capacidades alcance / faccio capacita / faco capacidades",
    "model": "language model/an ai/ai assistant/ai model / sprachmodell/ki assistent/chatbot / modele de langage / modelo de lenguaje / modello linguistico / modelo de linguagem",
    "pass": "have to pass/must pass/ll pass/will pass/going to pass",
}
_WORD = re.compile(r"[^\W_]+")
_QUOTED = re.compile(r"[“„«‘](?:[^”“»’]|(?<=\w)’(?=\w))*(?:[”“»’]|$)|\"[^\"]*(?:\"|$)|\([^)]*(?:\)|$)")
_SENTENCE = re.compile(r"(?<=[.!?…;])\s+|\n")
#: Words between the parts of a refusal: answerer and inability, inability and act, the words of an inability.
NEAR, ACT, INSIDE = 6, 9, 4


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    """Every word and phrase of the classes between blanks, with its classes and number of words."""
    classes: dict[str, set[str]] = {}
    for name, listed in CLASSES.items():
        for part in listed.split("/") if name in ("model", "pass") else listed.replace("/", " ").split():
            classes.setdefault(part.strip(), set()).add(name)
    out = ahocorasick.Automaton()
    for phrase, own in classes.items():
        out.add_word(f" {phrase} ", (phrase.count(" ") + 1, frozenset(own)))
    out.make_automaton()
    return out


@lru_cache(maxsize=1)
def triggers() -> dict[str, int]:
    """Single words: 1 for one of the answerer, 2 for one that can make a refusal. A refusal has both, or names a model."""
    out: dict[str, int] = {}
    for name, bit in (("self", 1), ("not", 2), ("unable", 2), ("decline", 2), ("bar", 2), ("beyond", 2)):
        for w in CLASSES[name].replace("/", " ").split():
            out[w] = out.get(w, 0) | bit
    return out | {"model": 3, "ai": 3, "sprachmodell": 3, "chatbot": 3, "ki": 3, "modele": 3, "modelo": 3, "modello": 3, "pass": 2}


def outside_quotations(text: str) -> str:
    return _QUOTED.sub(" ", text)


def declines(text: str) -> bool:
    """Whether the answerer, outside quotations, speaks of itself and declines or says that it is unable."""
    return any(_declines(_WORD.findall(s)) for s in _SENTENCE.split(outside_quotations(text)))


def _declines(words: list[str]) -> bool:
    folded = [fold_word(w) for w in words]
    plain = " " + " ".join(folded) + " "
    starts, at = {}, 1
    for i, w in enumerate(folded):
        starts[at] = i
        at += len(w) + 1
    places: dict[str, list[int]] = {k: [] for k in CLASSES}
    for end, (n, names) in automaton().iter(plain):
        begin = end
        for _ in range(n):
            begin = plain.rindex(" ", 0, begin)
        i = starts.get(begin + 1)
        if i is not None:
            for name in names:
                places[name].append(i)
    near = lambda name, a, b: any(a <= i <= b for i in places[name])
    if places["model"] and (places["not"] or places["unable"] or places["decline"]):
        return True
    if not places["self"]:
        return False
    if any(near("self", i - NEAR, i) for i in places["pass"]) or any(near("self", i - INSIDE, i + 1) for i in places["decline"]):
        return True
    inabilities = [(i, i) for i in places["unable"]]
    inabilities += [(min(i, j), max(i, j)) for i in places["not"] for j in places["able"] if abs(i - j) <= INSIDE]
    for a, b in inabilities:
        if near("self", a - NEAR, b + NEAR) and (near("act", a - INSIDE, b + ACT) or near("look", a - INSIDE, b + ACT) and near("object", a - NEAR, b + ACT)):
            return True
    for i in places["not"]:
        if near("object", i, i + 3) and near("self", i - NEAR - 2, i + NEAR) and (near("hold", i - NEAR, i + NEAR) or near("look", i - NEAR - 2, i + NEAR)):
            return True
        if near("rules", i - NEAR, i) and near("self", i - NEAR, i) and near("act", i, i + NEAR):
            return True
    for i in places["bar"]:
        if near("rules", i - NEAR, i) and near("act", i, i + NEAR):
            return True
    return any(near("self", i, i + NEAR) and (near("do", i, i + NEAR + 2) or near("able", i, i + NEAR)) and (places["act"] or near("able", i, i + NEAR)) for i in places["beyond"])
