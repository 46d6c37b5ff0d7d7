"""Word lists that results depend on. All are fixed values; operators take other lists as parameters where callers have their own."""

from __future__ import annotations

import csv
from functools import lru_cache
from pathlib import Path

# fixed values, all of this file


def _words(text: str) -> tuple[str, ...]:
    return tuple(text.split())


PREDICATES = (
    "UTILIZA", "EXECUTA", "PRODUZ", "CONECTA_A", "PERTENCE_A", "CONTIENE", "CONTRADIZ", "DISTRIBUIR", "APRENDE", "DEFINE", "SER", "POSSUIR", "DERIVA_DE", "INFLUENCIA", "FUNDOU",
    "PRESERVA", "TEORIZA", "É_AMIGÁVEL", "DEFENDEU", "VENCEU", "LOCALIZADO_EM", "DISPUTOU", "TREINOU",
)
FORMS = Path(__file__).with_name("predicate_forms.csv")
MODAL = _words("poder pode podia poderia poderao podem puder podendo dever deve devia deveria devem devera deverao devendo")
AMBIGUOUS = _words("passar passa passou passando passam aumentar aumenta aumentou aumentando aumentam")
STOPWORDS = _words(
    "the a an of in on at by for with from to and or as than into over under about after "
    "o os as um uma uns umas de do da dos das em no na nos nas por com para sem sobre entre ao aos que e ou se como mais menos"
)
NONVERBAL = _words("year years through story stories coder deepr deep code data thing things people time way day work part number world life hand place week case point")
KNOWN_VERBS = _words(
    "ser estar ter haver fazer poder dever ir vir dar ver saber querer usar utilizar empregar adotar criar produzir gerar executar processar conectar associar vincular "
    "pertencer conter incluir definir aprender distribuir difundir popularizar influenciar impactar possuir derivar permitir representar constituir publicar descrever passar treinar "
    "otimizar reduzir aumentar melhorar aplicar construir desenvolver implementar requerer precisar reconhecer identificar classificar prever detectar transformar combinar dividir analisar preservar teorizar "
    "causa causes causar resulta results resultar result contratar contratou liderar liderou atuuar atuou marcar pontuar campeoar assinar assinou transferir transferiu "
    "be is are have has do make use utilize employ adopt create produce generate execute process connect associate link belong contain include define learn distribute influence possess derive allow represent "
    "constitute publish describe pass train optimize reduce increase improve apply build develop implement require recognize identify classify predict detect transform combine divide analyze run support provide enable "
    "score scored captain captained sign signed transfer"
)
QUANTIFIERS = _words("maioria minoria alguns algumas muitos muitas poucos poucas todo toda todos todas cada nenhum nenhuma qualquer quaisquer")
PRONOUNS = _words(
    "isso isto aquilo este esta esse essa aquele aquela ele ela eles elas tal qual quem seu sua seus suas lhe lhes que "
    "this that these those he she it they we you i him her them us which who whom whose what whatever whoever anything something nothing everything everyone someone nobody everybody "
    "my his her our their your its mine ours yours theirs myself yourself itself themselves"
)
PREPOSITIONS = _words(
    "em de do da dos das no na nos nas com sem para por pelos pelas ao aos ate desde contra traz como mediante conforme segundo alem apesar embora quando onde enquanto porque pois assim portanto entre sob sobre apos antes durante "
    "and but or of to in on at for with by from as into onto upon about against between through during before after above below under over "
    "although though while whereas because since unless however therefore moreover furthermore nevertheless"
)
ADVERBIAL = _words("apos antes durante quando onde enquanto desde ate before after during when where while since until")
FUNCTION_WORDS = _words(
    "o a os as um uma uns umas e ou mas que de do da dos das no na nos nas em com sem por para ao aos as se lhe lhes seu sua seus suas este esta estes estas esse essa esses essas aquele aquela isso isto aquilo ele ela eles elas eu tu nos vos me te se "
    "the a an and or but of to in on at for with by from as into it its is are was were be been being this that these those he she they we you i him her them us which who whom what "
    "there here then than if when while because although though so not no do does did have has had"
)
DISCOURSE = _words("enfim portanto logo assim pois contudo todavia entretanto aliás alias obviamente claro primeiro primeira segundo terceiro próximo proximo finally however therefore thus indeed first second third next anyway anyways")
DISCOURSE_START = _words("enfim portanto logo contudo todavia entretanto obviamente finally however therefore indeed anyway anyways thus")
CLAUSE_START = ("que ", "o que", "para que", "porque")
CLAUSE_WITHIN = (" de modo que", " de forma que", " para que", " porque", " pois ", " embora ", " quando ", " onde ", " enquanto ", " that ", " which ", " who ", " whom ")
RELATIVE = _words("que that which who whom whose")
COPULAS = _words("ser foi era eram sao estao is are was were be been being")
COMPLEMENT_START = _words(
    "known famous popular impressed interested involved located based situated considered regarded called nicknamed ranked dated born educated employed retired "
    "named given received labeled labelled classified included provided introduced coined recorded built inaugurated represented dismissed scored replaced owned coached managed sponsored defeated founded eliminated "
    "used purchased tried questioned was were is are been being so very too quite extremely particularly especially"
)
COMPARATIVES = _words("older younger bigger greater higher lower quicker faster better worse more less different")
UI_MARKERS = (
    "clique", "execute o", "execute este", "instale", "instalar o pacote", "configure o", "rode o", "rode o comando", "abra o", "acesse o", "baixe o",
    "copie o", "import ", "print(", "console.log", "npm ", "pip install", "pip3 install", "```", "referências", "referencias", "ver também", "ver tambem",
    "editar", "leia mais", "saiba mais", "assine", "newsletter", "compartilhe", "siga-nos", "categoria:", "cookie", "tutorial", "passo a passo",
)
IMPERATIVES = ("clique", "execute", "instale", "configure", "rode", "acesse", "baixe", "copie", "importe", "abra", "crie o", "adicione")
CODE_CHARS, CODE_SUFFIXES = "\\/@#_=<>{}()[]|", _words("com org net io dev py js json html md")
SPAN_PUNCTUATION, SPAN_CODE = ".,;:!?()[]{}\"'`-", "{}[]<>|\\/=_@#~^`"


@lru_cache
def predicate_forms(path: str | None = None) -> dict[str, str]:
    """Folded form -> controlled predicate, from the lines `form,PREDICATE` of a file (without one: FORMS)."""
    with open(path or FORMS, encoding="utf-8") as f:
        return {row[0]: row[1] for row in csv.reader(f) if row and not row[0].startswith("#")}
TERM_NOISE = ("portal", "categoria", "wikipédia", "wikipedia", "editar", "código", "ver também", "commons", "wikcionário", "wikidata", "ficheiro")
TERM_PRONOUNS = _words("que isso isto aquilo ele ela eles elas seu sua seus suas este esta estes estas esse essa esses essas lhe lhes me te nos vos o a os as algo tudo nada")
TRAILING = _words("que em de da do das dos a o as os e ao aos com para por no na nos nas se como mais")
DETERMINERS = _words("o a os as um uma uns umas the an this that these those")
GENERIC_NOUNS = _words(
    "club clubs team teams side squad player players footballer striker goalkeeper defender midfielder coach manager crowd fans fan city country state region "
    "father son daughter mother brother year years season game match title "
    "clube clubes time times equipe elenco jogador jogadores futebolista goleiro zagueiro tecnico torcida cidade pais estado regiao pai filho filha mae irmao ano anos temporada jogo jogos partida partidas titulo titulos"
)
TABLE_ONLY, NARRATIVE_AND_TABLE = ("rsssf.org",), ("pt.wikipedia.org", "en.wikipedia.org")
