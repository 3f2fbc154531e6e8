"""Voters on plain passages: general lexicons of English, Spanish and Portuguese, and patterns made of them.

A voter is a pattern over words of a kind (a person addressed, an insult, a verb of violence, a group of people, ...);
none holds a clause of its own. Letters come without accents and in lower case. A voter is asked only where one of the
words stands that each of its matches must hold.
"""

from __future__ import annotations

import re

_s = str.split

# ------------------------------------------------------------------ lexicons
#: Insults that only a person is called.
INSULTS = _s(
    "idiot idiots moron morons imbecile imbeciles bitch bitches bastard bastards asshole assholes ashole arsehole scumbag scumbags scum loser losers dimwit halfwit nitwit jackass shithead dickhead fuckhead clown clowns fool fools cretin cretins "
    "whore whores slut sluts hooker dumbass jerk jerks prick pricks cunt cunts twat twats wanker retard retards freak freaks coward cowards pervert bimbo faggot faggots nigger niggers bozo lowlife "
    "idiota idiotas imbecil imbeciles imbecis payaso payasos pendejo pendejos pendeja tarado tarada tarados cabron cabrones cabrona gilipollas zorra zorras puta putas puto maricon maricones malnacido malnacida malnacidos desgraciado desgraciada desgraciados subnormal boludo pelotudo culero "
    "mamon bruja cobarde sudaca sudacas estupido estupida estupidos estupidas hijueputa "
    "palhaco palhacos otario otarios otaria babaca babacas vagabundo vagabunda vagabundos desgracado desgracada cretino cretina cuzao arrombado vadia vadias viado viados covarde corno trouxa escroto canalha canalhas"
)
#: What else a person is called as an insult, though it is also said of animals and things.
THINGS = _s(
    "pig pigs rat rats cow cows dog dogs snake snakes worm worms swine donkey donkeys ape apes monkey monkeys parasite parasites vermin cockroach cockroaches trash garbage filth waste crap shit savage savages animal animals hag witch "
    "cerdo cerdos cerda rata ratas burro burros burra perro perros perra perras vaca vacas gusano gusanos basura basuras escoria mierda parasito parasitos animal animales salvaje salvajes mono monos gordo gorda inutil inutiles "
    "porco porcos porca rato ratos burra burras verme vermes lixo lixos macaco macacos parasita parasitas animais selvagem selvagens merda bosta inuteis"
)
SCORN = _s(
    "worthless useless pathetic stupid ugly disgusting brainless shitty fucking filthy dumb lazy ignorant miserable rotten slimy stinking lousy vile revolting spineless incompetent retarded idiotic moronic crappy lying cheap dirty mindless clueless "
    "retrasado retrasada retardado retardada asqueroso asquerosa asquerosos asquerosas maldito maldita malditos malditas patetico patetica estupido estupida estupidos inmundo inmunda repugnante ignorante ignorantes tonto tonta tontos tontas feo fea vago vaga vagos inutil inutiles mugroso mugrosa "
    "nojento nojenta imundo imunda imundos ridiculo ridicula burro burra burros burras feio feia preguicoso preguicosa preguicosos sujo suja sujos estupidos ignorante idiota"
)
#: Strong words of dehumanising and of blame for a whole group.
DEHUMAN = _s(
    "vermin subhuman subhumans savages cockroaches disease plague parasites parasite trash scum animals rats filth pest pests cancer garbage pigs monkeys apes dogs "
    "escoria basura salvajes plaga plagas parasitos ratas cucarachas animales mierda bestias cerdos monos lacra cancer enfermedad "
    "lixo selvagens praga pragas parasitas ratos baratas animais bestas porcos macacos vermes doenca"
)
BLAME = _s(
    "thieves liars criminals rapists inferior burden lazy dirty stupid dumb terrorists scammers ladrones mentirosos criminales inferiores vagos sucios tontos violadores delincuentes terroristas ladroes mentirosos criminosos inferiores preguicosos sujos burros burras bandidos estupradores terroristas"
)
GROUPS = _s(
    "migrants migrant immigrants immigrant foreigners foreigner refugees refugee muslims muslim jews jew christians catholics protestants hindus blacks whites asians africans latinos mexicans gypsies gypsy roma arabs indians natives women girls gays gay lesbians homosexuals trans transsexuals "
    "disabled cripples peasants villagers outsiders strangers elderly feminists atheists believers "
    "migrantes inmigrantes extranjeros extranjero extranjera refugiados musulmanes judios cristianos negros negras indios indias indigenas gitanos gitanas mujeres homosexuales lesbianas lisiados discapacitados forasteros moros chinos arabes campesinos ancianos "
    "imigrantes estrangeiros refugiados muculmanos judeus cristaos pretos pretas ciganos mulheres homossexuais lesbicas aleijados deficientes forasteiros nordestinos idosos indigenas"
)
KIN = _s("mother father mom dad wife husband sister brother daughter son family parents kids children teacher madre padre mama papa esposa esposo marido hermana hermano hija hijo familia padres hijos mae pai mulher irma irmao filha filho filhos pais")
PERSONS = _s(
    "he she intern foreman boss man woman guy girl boy rater annotator labeller labeler colleague neighbour neighbor driver manager supervisor picker farmer student worker whoever who "
    "ella capataz jefe jefa anotador anotadora vecino vecina tipo tipa hombre mujer chico chica vieja viejo quien "
    "ele ela chefe anotador anotadora vizinho vizinha homem sujeito moca quem"
)
#: Verbs that hurt whoever is their object, and verbs that do with a part of the body or a home as object.
KILL = _s("kill murder rape strangle stab shoot hang choke drown poison behead stone lynch whip gas slaughter butcher torture beat burn bury exterminate deport hunt")
KILL_ES = _s(
    "matar asesinar violar ahorcar fusilar estrangular degollar apunalar quemar golpear linchar torturar exterminar eliminar deportar expulsar echar encerrar castrar esterilizar dejar "
    "estuprar enforcar fuzilar esfaquear queimar espancar bater deportar prender trancar chicotear castrar esterilizar deixar degolar surrar"
)
HURT = _s("break smash cut slit crush cave burn rip tear beat kick punch bash split snap twist blow rearrange chop romper partir cortar quebrar reventar arrancar quemar arrebentar rasgar queimar")
BODY = _s(
    "legs leg neck throat face arms arm bones teeth jaw fingers skull head nose ribs knees hands eyes house home car family kids brains guts heart balls "
    "piernas cuello garganta cara brazos huesos dientes dedos craneo cabeza nariz costillas rodillas casa coche familia hijos corazon "
    "pernas pescoco garganta cara bracos ossos dentes dedos cranio cabeca nariz costelas joelhos casa carro familia filhos"
)
#: What one wishes on a hated person, after I hope, may, ojala, tomara.
HARM = _s(
    "die dies dead choke chokes crash crashes rot rots burn burns suffer suffers drown drowns bleed bleeds starve starves cancer perish crushed crushes "
    "muera mueras mueran pudra pudras pudran sufra sufras ahogues ahogue quemes queme atropelle estrelles coman cancer revientes reviente pegue caigas desangres "
    "morra morras morram apodreca apodrecas sofra sofras queime afogue atropele exploda exploda cancer"
)
BEATEN = _s(
    "shot hanged hung stoned burned burnt whipped beaten lynched gassed exterminated deported murdered killed starved drowned locked caged castrated sterilised sterilized expelled enslaved chained raped flogged eradicated executed slaughtered shipped wiped driven thrown kicked banned kept "
    "exterminados expulsados fusilados encerrados deportados quemados ahorcados castrados eliminados exterminados expulsos fuzilados presos deportados queimados enforcados eliminados mortos trancados"
)
SEX = _s(
    "nudes nude porn porno horny blowjob handjob cum tits pussy dick cock boobs topless sex xxx anal orgasm naked slut sluts whore fuck fucking fucked sexy "
    "tetas desnuda desnudas desnudo desnudarte chuparte follarte cogerte cachondo cachonda follar coger polla pija culo chupamela chupala manosearte sexo porno pornografia orgasmo verga caliente excitado excitada "
    "pelada pelado peladas tesao trepar chupar buceta transar gozar foder comer peitos gostosa pau rola punheta nudez putaria excitado excitada"
)
#: Sexual words that hardly have another sense.
PORN = _s(
    "nudes porn porno horny blowjob handjob tits pussy boobs xxx orgasm tetas desnudarte chuparte follarte cogerte cachondo cachonda follar chupamela chupala manosearte pornografia orgasmo tesao buceta transar punheta putaria gostosa comtesao"
)
CUSS = _s("fuck fucking fucker fucked shit shitty bullshit damn bloody motherfucker crap mierda carajo coño cono joder jodete jodanse jodido chingada chinga verga merda porra caralho foder foda fodase puta cacete bosta")

_PESTS = _s(
    "aphid aphids weevil weevils cutworm cutworms armyworm armyworms borer borers locust locusts thrips beetle beetles mite mites moth moths larva larvae caterpillar caterpillars slug slugs grasshopper grasshoppers insect insects weed weeds fungus fungi spore spores crows birds "
    "pulgones pulgon cogollero gusanos orugas oruga gorgojo gorgojos langostas insectos insecto hongo hongos maleza malezas trips polilla chinches "
    "lagartas lagarta pulgoes gorgulho gorgulhos insetos inseto fungos fungo percevejo percevejos gafanhotos larvas cigarrinha cigarrinhas"
)
#: Plants, tools, pictures and programs: harsh words about them are no abuse.
_OBJECTS = _s(
    "leaf leaves stalk stalks stem stems ear ears seed seeds seedling seedlings kernel kernels husk tassel crop crops field plot plots rows silo store barn soil rot rust blight photo photos picture pictures image images frame frames file files job jobs process script branch worker camera lens tripod pump label labels data model parser bug cable battery memory weather rain wind mistake "
    "hoja hojas tallo tallos mazorca mazorcas semilla semillas rastrojo rastrojos lote parcela foto fotos imagen imagenes archivo archivos proceso camara lente tripode bomba cable lluvia viento dia error "
    "folha folhas espiga espigas semente sementes planta plantas lavoura talhao fotos imagem imagens arquivo arquivos processo lente tripe bomba chuva vento dia erro"
)


def _any(*words: list[str]) -> str:
    return "(?:" + "|".join(sorted({re.escape(w) for ws in words for w in ws}, key=lambda w: (-len(w), w))) + ")"


_I, _T, _A = _any(INSULTS), _any(THINGS), _any(SCORN)
_BAD = _any(INSULTS, THINGS, SCORN)
_JOIN = rf"(?:\W+(?:are|re|is|r|were|was|a|an|such|just|nothing|but|the|most|biggest|dumbest|really|so|too|complete|total|absolute|utter|bunch|of|all|ever|little|old|fat|poor|damn|bloody|whole|kind|piece|un|una|unos|unas|tan|muy|puro|pura|puros|puras|todo|todos|toda|el|la|los|las|mas|pedazo|cacho|de|e|um|uma|uns|umas|muito|tao|bem|mesmo|so|completo|o|os|as|{_A}))*"
_YOU = r"(?:you|u|youre|yall|eres|sos|sois|tu|vos|usted|ustedes|voces?|vc|seus?|suas?)"
_ME = r"(?:me|us|everyone|everybody|the world|humanity|nos|mundo|todos)"
_G = r"(?:\W+\w+)"
_GROUP = rf"(?:{_any(GROUPS)}|people (?:with|from|of) (?:that|this|those|these|your) \w+|(?:those|these|that|such) people|(?:old|poor|fat|trans|city|mountain|black|brown|white|gay) (?:folks?|people)|\w+ tribe|(?:los|las) de (?:esa|ese|la|aquella|aquel) \w+|(?:esa|essa) (?:gente|raza|raca|tribu|tribo|chusma|corja)|os d(?:a|e|essa|aquela) \w+|los (?:viejos|gordos|pobres)|os (?:velhos|gordos|pobres))"
_THEY = rf"(?:{_GROUP}|they|them|ellos|ellas|eles|elas)"
_DE = _any(DEHUMAN)
_ARE = r"(?:are|re|were|is|son|sao|es|e)"
_MUST = r"(?:should|must|ought to|need to|needs to|have to|has to|deserves?|belongs?|deserve to|deberian|debieran|tendrian que|merecen|deviam|deveriam|devem|merecem|tem que|tinham que)"
_SELF = r"(?:yourself|urself|yourselves)"
_WHERE = r"(?:bridge|well|silo|combine|river|canal|train|traffic|fire|roof|cliff|lake|window|puente|pozo|rio|tren|canal|techo|barranco|fuego|ponte|poco|trem|telhado|fogo|penhasco)"
_POISON = r"(?:poison|bleach|herbicides?|pesticides?|weedkiller|acid|bait|venenos?|herbicidas?|cloro|lejia|acido|raticidas?|insecticidas?|agrotoxicos?)"

#: Name -> (pattern, words of which a match holds at least one); an empty pattern means any of the words.
VOTERS: dict[str, tuple[str, list[str]]] = {
    "insult_direct": (
        rf"\b{_YOU}{_JOIN}\W+(?:{_I}|{_T})\b|\b(?:you|youre|u)(?:\W+(?:are|re|r))?{_JOIN}\W+{_A}\b|\b(?:eres|sos|sois|voces?|vc){_JOIN}\W+{_A}\b|\b(?:{_I}|{_T})\W+(?:like|como)\W+(?:you|tu|vos|voces?|him|her|ele|ela)\b|\bque\W+{_BAD}(?:\W+(?:tan|tao)\W+\w+)?\W+(?:eres|sos|voce|tu)\b|\b(?:you|te|voce)\W+(?:act|look|smell|sound|behave|ves|hueles|parece)s?\W+like{_JOIN}\W+(?:{_I}|{_T})\b|\b(?:what|such)\W+an?(?:\W+{_A})*\W+(?:little\W+)?(?:{_I}|{_T})\W+(?:you|he|she|they)\b|\byour?\W+{_A}\W+(?:mouth|face|ass|brain|head|family|self)\b",
        INSULTS + THINGS + SCORN,
    ),
    "insult_called": (
        rf"(?:^|[,;:]\W*)(?:(?:you|hey|listen|look|oye|oiga|ei|such|what|a|an|que|seu|sua|pinche|{_A})\W+)*{_I}(?:\W+{_BAD})*\W*(?:$|[,;:])|\bque\W+{_BAD}\W+(?:tan|tao)\W+{_BAD}\b|\b(?:hijo de puta|hijos de puta|filhos? da puta|sons? of a bitch|piece of shit|pedazo de mierda|pieces of shit|pedaco de merda)\b",
        INSULTS + THINGS + SCORN,
    ),
    "insult_third": (rf"\b{_any(PERSONS, KIN)}\b{_G}{{0,6}}?\W+{_ARE}{_JOIN}\W+(?:{_I}|{_T})\b|\b{_any(PERSONS)}\W+{_ARE}{_JOIN}\W+{_A}\b|\b(?:your|tu|sua|tua)\W+(?:\w+\W+)?{_any(KIN)}\W+{_ARE}{_JOIN}\W+{_BAD}\b|\b(?:is|es|e)\W+(?:un|a|an|um|uma|una)\W+(?:hijo de puta|filho da puta|piece of shit|son of a bitch)\b", INSULTS + THINGS + SCORN),
    "insult_word": (rf"\b{_I}\b|\b{_A}\W+(?:{_T}|{_A})\b|\b{_T}\W+{_A}\b", INSULTS + SCORN),
    "contempt": (
        rf"\b(?:shut|close)\W+(?:your|ur|the fuck)(?:\W+\w+)?\W+(?:mouth|trap|face|hole|up)\b|\bshut\W+(?:the\W+\w+\W+)?up\b|\bgo\W+to\W+hell\b|\brot in hell\b|\bburn in hell\b|\b(?:screw|fuck|damn|curse)\W+(?:you|off|yourself|your)\b|\bpiss off\b|\bdrop dead\b|\bgo (?:die|drown|hang|fuck)\b|\bget lost\b|\bcrawl back\b|\b(?:you|he|she|they) makes? me (?:sick|puke|vomit)\b|\bwaste of (?:space|air|oxygen|skin|time and skin)\b|\bgood for nothing\b|\b(?:people|scum|folk|women|men) like you\b|\bspit (?:on|at|in) (?:you|your)\b"
        rf"|\bcallate\b|\bcierra (?:la|esa|tu) (?:boca|jeta)\b|\b(?:vete|vayanse|andate) (?:a la mierda|al infierno|al diablo|a la chingada|al carajo)\b|\bjodete\b|\bque te (?:jodan|den|follen)\b|\bchinga tu\b|\bme das? asco\b|\b(?:gente|gentuza|basura) como (?:tu|vos|ustedes)\b|\bno (?:vales|sirves para) nada\b|\bescupo (?:en|sobre|a)\b|\blargate\b"
        rf"|\bcala a (?:tua |sua )?boca\b|\bvai (?:se foder|tomar no|a merda|pra merda|pro inferno|para o inferno|a puta|se danar)\b|\b(?:some|suma)\W+(?:daqui|da minha)\b|\b(?:voce|tu) me (?:da|das) nojo\b|\bgente como (?:voces?|tu)\b|\bnao (?:vale|vales|serves|serve) (?:para )?nada\b|\bcuspo (?:em|na|no)\b|\bte odeio\b|\bte odio\b|\bi hate you\b"
        rf"|\byour\W+(?:whole\W+)?{_any(KIN)}\b{_G}{{0,4}}?\W+(?:ashamed|embarrassed|disgusted|regrets?)\b|\b(?:nobody|no one) (?:likes|loves|wants|needs) you\b|\bnadie te (?:quiere|soporta|aguanta|extranaria|extrana)\b|\bninguem (?:gosta de|te quer|te suporta|te ama|sentiria)\b|\bnobody would (?:miss|cry|mourn|notice|care)\b|\bbetter off without you\b",
        _s("shut close hell screw fuck damn curse piss drop go get crawl sick puke vomit waste nothing people scum folk women men spit callate cierra mierda infierno diablo chingada carajo jodete jodan den follen chinga asco gente gentuza basura vales sirves escupo largate cala foder tomar merda danar daqui minha nojo vale serves serve cuspo odeio odio hate ashamed embarrassed disgusted regret regrets nobody likes loves wants needs nadie ninguem better puta"),
    ),
    "threat": (
        rf"\b(?:i|we|ill|im|gonna)\b{_G}{{0,5}}?\W+{_any(KILL)}\W+(?:you|u|ur|your (?:whole )?{_any(KIN)}|her|him)\b|\b(?:i|we|ill|will|gonna)\b{_G}{{0,6}}?\W+{_any(HURT)}\W+(?:your|ur|his|her|their)(?:\W+\w+)?\W+{_any(BODY)}\b|\b{_any(KILL)}(?:s|ed)? you (?:like|in|with|and|if|slowly|tonight|tomorrow|one|first)\b|\bwatch your back\b|\byou (?:are|re|will be) (?:dead|a dead)\b|\byou (?:will|ll|are going to|shall|gonna) (?:die|pay|regret|suffer|bleed|burn|beg)\b|\b(?:i|we) know where (?:you|your)\b|\b(?:i|we)(?:\W+(?:will|ll|am|m))?\W+(?:come|coming) (?:for|after) you\b|\bfind (?:you|your (?:house|home|family|kids|car|mother|wife))\b{_G}{{0,6}}?\W+(?:and|then)\b{_G}{{0,2}}?\W+{_any(KILL, HURT)}\b|\bhunt (?:you|your)\b|\b(?:let me|going to|gonna|want to) {_any(KILL)} (?:you|her|him)\b"
        rf"|\bte (?:voy|vamos) a {_any(KILL_ES, HURT)}\b|\bte (?:matare|rompere|quemare|rajare|partire|cortare|encontrare|buscare|reventare|mato)\b|\bvoy a (?:matar|romper|quemar|partir|cortar|reventar|violar|golpear|ahorcar|degollar)te\b|\b(?:quemar|romper|incendiar) tu {_any(BODY)}\b|\bse donde (?:vives|vive)\b|\bvas a (?:morir|pagar|sufrir|sangrar|llorar|arrepentirte)\b|\bte arrepentiras\b|\b(?:romper|partir|cortar)(?:te)? (?:los|las|la|el|tus?) {_any(BODY)}\b"
        rf"|\bvou te {_any(KILL_ES, HURT)}\b|\bte (?:mato|quebro|arrebento)\b|\bvou {_any(KILL_ES, HURT)} (?:voces?|a sua|tua|teus?|os teus|os seus|sua|seus?)\b|\bsei onde (?:voce|tu) mora\w*\b|\bvou atras d\w+ (?:tua|sua|voce)\b|\bvou atras de voce\b|\bvoce vai (?:morrer|pagar|sofrer|sangrar|se arrepender)\b|\b(?:te )?(?:quebrar|quebro|arrebentar) (?:os|as|a|tua|teus?|sua|seus) {_any(BODY)}\b",
        KILL + HURT + KILL_ES + _s("watch dead die pay regret suffer bleed burn beg know come coming find hunt matare rompere quemare rajare partire cortare encontrare buscare reventare mato matarte romperte quemarte partirte cortarte reventarte violarte golpearte ahorcarte degollarte incendiar vives vive vas arrepentiras sei atras vai quebro arrebento stabs kills killed stabbed shoots murders murdered cortarte romperte partirte voy"),
    ),
    "harm_wish": (
        rf"\b(?:hope|wish|hopefully|may|let)\b{_G}{{0,2}}?\W+(?:you|your|he|she|they|his|her|their|u|ur)\b{_G}{{0,7}}?\W+{_any(HARM)}\b|\b(?:hope|hopefully|may)\b{_G}{{0,4}}?\W+(?:runs?|rolls?|drives?|falls?|eats?|bites?|kills?|hits?|crush(?:es)?|find|finds|get|gets|tears?)\W+(?:over\W+|on\W+)?you\b|\b(?:runs|rolls|drives) (?:you over|over you)\b|\b(?:ojala|espero|tomara|quiero|quero|que)\b(?:\W+que)?(?:\W+(?:te|ti|tu|tus|se|voces?|o|a|os|teus?|tua|seus?|sua|ellos|eles|todos|el|la|los|las)\b)?{_G}{{0,3}}?\W+{_any(HARM)}\b|\b(?:ojala|tomara|espero)\b{_G}{{0,5}}?\W+(?:pas[es]e|pase|passe)\b{_G}{{0,4}}?\W+por (?:encima|cima)\b"
        rf"|\b(?:kill|hang|hanged|shoot|drown|off|stab|burn|poison) {_SELF}\b|\bkys\b|\b(?:jump|walk|throw {_SELF}|fall|leap|go)\W+(?:off|into|in front of|under|from|in)\W+(?:the|a|an|your|that)(?:\W+\w+)?\W+{_WHERE}\b|\b(?:go|just) (?:die|drown)\b|\bif you (?:died|hanged|were dead|never woke)\b|\bdo {_ME}(?:\W+all)?\W+(?:a|the) favou?r\W+and\W+(?:die|jump|walk|disappear|drop|drink|hang|kill|vanish|drown)\b"
        rf"|\b(?:matate|mata te|suicidate|ahorcate|muerete|mate se|se mata|se enforca|enforca te|enforque se|pegate un tiro|pega(?:te)? fuego)\b|\b(?:tirate|tira te|lanzate|arrojate|avientate|se joga|joga te|pula|pule) (?:de|del|al|a|ao|da|do|na|no|por)(?:\W+\w+)?\W+{_WHERE}\b|\bfavor (?:y|e) (?:desaparece|muerete|matate|tirate|bebe|tragate|toma|some|morre|morra|ahorcate|suicidate|pula|bebete|vai)\b|\bdesaparece (?:para|de) (?:siempre|la tierra|aqui)\b|\bsome (?:para|pra) sempre\b"
        rf"|(?<!not )(?<!never )(?<!no )(?<!nao )(?<!dont )\b(?:drink|swallow|bebe|bebete|tragate|traga|toma|tomate|beba|tome|engole|engula)\W+(?:(?:the|some|a|el|un|o|um|rat|tu)\W+){{0,2}}{_POISON}\b"
        rf"|\b(?:never|not|no|nao) (?:should |deberia[ns]? |devia[ms]? |deveria[ms]? )?(?:have been |haber |ter )(?:born|nacido|nascido)\b|\b(?:you|he|she|they|women|men|people)\b{_G}{{0,2}}?\W+(?:deserves?|should) (?:to )?(?:die|suffer|be dead|rot|hang|burn)\b|\bdeserves? to be {_any(BEATEN)} until\b|\bmerece[ns]? (?:morir|la muerte|sufrir|que te)\b|\bmerecem? (?:morrer|a morte|sofrer|apanhar)\b|\bshould be (?:murdered|raped|tortured|lynched|hanged|beaten) (?:in|like|until|by|for|to)\b|\b(?:he|she|you)\W+(?:should|deserves? to|must)\W+be\W+{_any(BEATEN)}\b|\bsomebody (?:should|ought to|must) {_any(KILL)}\b|\bsomeone (?:should|ought to|must) {_any(KILL)}\b",
        HARM + _s(" ".join(re.findall("[a-z]+", _WHERE)) + " hope hopefully may runs rolls drives pase passe kill hang hanged shoot drown off stab burn poison kys died die woke favour favor matate mata suicidate ahorcate muerete mate enforca enforque pegate tirate tira lanzate arrojate avientate joga pula pule desaparece some drink swallow bebe bebete tragate traga toma tomate beba tome engole engula born nacido nascido deserve deserves should merece mereces merecen merecem somebody someone pega"),
    ),
    "group_dehumanised": (
        rf"\b{_THEY}\b(?:{_G}{{0,3}}?\W+{_ARE}|\W*,)?(?:\W+(?:a|an|all|all of them|nothing but|una|unos|unas|un|uma|uns|puros|puras|puro|todos|todas|just|only|like|no|una|such|so|sino))*\W+{_DE}\b|\ball of them\b{_G}{{0,2}}?\W+{_DE}\b|\bpur[oa]s (?:un[ao]? )?{_DE}\b|\b(?:breed|multiply|se reproducen|se reproduzem)\W+(?:like|como)\W+(?:a |an |las? |os |as |los )?{_DE}\b|\b(?:all|todos|todas)\b{_G}{{0,2}}?\W+{_ARE}(?:\W+\w+)?\W+{_DE}\b",
        DEHUMAN,
    ),
    "dehuman_word": (rf"\b{_ARE}(?:\W+(?:a|an|una?|uma?|all|nothing but|puros|puras|unos|unas|uns))*\W+{_DE}\b", DEHUMAN),
    "group_excluded": (
        rf"\b{_GROUP}\b{_G}{{0,9}}?\W+{_MUST}{_G}{{0,3}}?\W+(?:{_any(BEATEN)}|die|starve|burn|hang|disappear|chains|cages?|kitchen|camps?|zoo|jaula|cocina|cozinha|sumir|desaparecer|morir|morrer|put down)\b|\b{_any(KILL)}\b{_G}{{0,3}}?\W+(?:all|every|those|these|each|the)\b{_G}{{0,2}}?\W+{_GROUP}\b|\b(?:hang|shoot|whip|deport|lynch|kick|throw|send|ship|get rid of|keep|stone|gas)\b{_G}{{0,3}}?\W+(?:all|every|those|these|the|them)?\W*{_GROUP}\b|\bship (?:them|you) (?:all )?back\b|\bgo back to (?:your|their)(?:\W+\w+)?\W+(?:country|land|village|hole|cave|jungle)\b|\bnever (?:let|allow|trust|hire|believe) (?:an? |any |the )?{_GROUP}\b|\b{_GROUP}\b{_G}{{0,4}}?\W+(?:do not|dont|should not|shouldnt|must not|should never|only) (?:belong|be allowed|vote|have rights|good for|breed)\b"
        rf"|\b(?:deberian|hay que|habria que|tenemos que|tendrian que|deviam|tem que|temos que|deveriam|haveria que|teria que)\W+{_any(KILL_ES)}(?:l[oa]s)?\W+(?:a\W+)?(?:(?:todos|todas|cada|los|las|esos|esas|os|as|esses|essas)\W+)*{_GROUP}\b|\b{_GROUP}\b{_G}{{0,8}}?\W+(?:que|deberian|habria que|hay que|tem que|teria que)\W+{_any(KILL_ES)}(?:l[oa]s|[ -]l[oa]s| eles| elas)?\b|\bsobra[nm] (?:l[oa]s|[oa]s|est[oa]s|ess[ea]s)\b|\b{_GROUP}\b{_G}{{0,3}}?\W+(?:solo|so|apenas) (?:sirven|servem)\b|\b(?:largate|vuelve|volta|vete|regresa|voltem) (?:a|para|pra) (?:o )?(?:tu|teu|seu|sua) (?:pais|tierra|terra)\b",
        BEATEN + KILL + KILL_ES + _s("die starve burn hang disappear chains cage cages kitchen camp camps zoo jaula cocina cozinha sumir desaparecer morir morrer put ship send get keep kick throw go never belong allowed vote good breed sobran sobram sirven servem largate vuelve volta vete regresa voltem exterminarlos exterminarlas matarlos matarlas echarlos echarlas quemarlos quemarlas encerrarlos encerrarlas dejarlos dejarlas expulsarlos eliminarlos fusilarlos ahorcarlos deportarlos castrarlos lincharlos golpearlos"),
    ),
    "exclude_words": (
        rf"\b(?:should|must|deserves? to|ought to)(?: all)? be {_any(BEATEN)}\b|\b(?:hay|habria|deberian|tendrian|toca|tem|teria|haveria)(?: que)? {_any(KILL_ES)}[ -]?(?:l[oa]s|eles|elas)\b|\bdeviam ser {_any(BEATEN)}\b|\bthey (?:are|re) too {_A}\b|\ba palos\b",
        BEATEN + SCORN + _s("hay habria deberian tendrian toca tem teria haveria deviam palos"),
    ),
    "group_hated": (
        rf"\b(?:i|we|all)?\W*(?:hate|despise|loathe|detest|cant stand|cannot stand)\b(?:\W+(?:all|those|these|the|every|fucking|you|damn|dirty))*\W+{_GROUP}\b|\b(?:odio|odiamos|detesto|aborrezco|no soporto)\W+a\W+(?:(?:todos|todas|los|las|esos|esas)\W+)*{_GROUP}\b|\b(?:odeio|odiamos|detesto|nao suporto)\W+(?:(?:todos|todas|os|as|esses|essas)\W+)*{_GROUP}\b|\b{_GROUP}\b{_G}{{0,2}}?\W+{_ARE}{_JOIN}\W+(?:{_any(BLAME)}|{_A}|{_I})\b|\ball {_GROUP}\W+{_ARE}\b{_G}{{0,2}}?\W+{_any(BLAME)}\b|\btoo {_A} to (?:think|learn|read|count|understand|work|vote|live|speak|hold|see|write|know|breathe)\b|\bdemasiado (?:tont|estupid|vag)\w+\b|\bstinks?\b{_G}{{0,4}}?\W+(?:full|because) of {_GROUP}\b|\b(?:huele|apesta|fede)\b{_G}{{0,6}}?\W+(?:llen[oa]|chei[oa]) de {_GROUP}\b",
        _s("hate despise loathe detest stand odio odiamos detesto aborrezco soporto odeio suporto too demasiado stink stinks huele apesta fede") + BLAME + SCORN + INSULTS,
    ),
    "hate_words": (r"\bi (?:hate|despise|loathe) (?!it|this|that|rain|when|how|the|to|my|working|waiting)\w+|\bodio a l[oa]s\b|\bodeio (?:os|as)\b", _s("hate despise loathe odio odeio")),
    "group_named": (rf"\b{_GROUP}\b", GROUPS + _s("people folk folks tribe gente raza raca tribu tribo chusma corja viejos gordos pobres velhos")),
    "porn_word": (rf"\b{_any(PORN)}\b|\bvideos? de sexo\b|\bcom ?tesao\b|\bnaked (?:pics?|pictures|photos|girls?|body|women|teens?)\b|\bsex (?:tapes?|videos?|chat|cam)\b|\b(?:fotos?|videos?) (?:tuyas? )?(?:desnuda|pelada|caliente|nua)s?\b", PORN + _s("video videos comtesao naked sex desnuda desnudas pelada peladas nua nuas")),
    "sex_word": ("", SEX),
    "solicitation": (
        rf"\b(?:send|show|give|mail|text)\W+(?:me|us)\b{_G}{{0,3}}?\W+{_any(SEX)}\b|\b(?:mandame|manda|enviame|envia|ensename|muestrame|pasame|mostra|mostre|me manda)\b{_G}{{0,4}}?\W+{_any(SEX)}\b|\b(?:want|need|going|gonna|let me|love|like|dying)\b{_G}{{0,3}}?\W+(?:fuck|lick|suck|ride|bang|hump|grope|screw|spank|taste|strip|bend|undress|touch)\W+(?:you|your|u|ur|me)\b|\b(?:suck|lick|ride|touch|stroke) (?:my|his|your|on my)(?:\W+\w+)?\W+(?:{_any(SEX)}|balls|ass|body)\b|\bbend (?:you|her|him|me) over\b|\bbend over\b.*\b(?:for me|baby|hard)\b|\bgrope (?:you|her|me|him)\b|\bi am so (?:hard|wet|horny|turned on)\b|\b(?:hot|horny|naked|sexy|naughty|slutty)\W+(?:\w+\W+)?(?:teens?|girls?|sluts?|milfs?|babes?|singles|nudes|body|pickers|women|boys)\b|\b(?:watch|click|free)\b{_G}{{0,3}}?\W+(?:porn|porno|nudes?|xxx|sex|naked|topless)\b|\bmy (?:\w+ ){{1,2}}(?:body|dick|cock|pussy|lips) (?:needs|wants|gets|is)\b|\b(?:dick|cock) gets hard\b"
        rf"|\b(?:quiero|voy a|vamos a|quisiera|ganas de|te voy a)\W+(?:follar|coger|chupar|lamer|montar|manosear|desnudar|tocar|cogerte|follarte|chuparte|lamerte|montarte|manosearte|desnudarte|tocarte|clavarte)(?:te|la|lo)?\b(?!\W+(?:las? hojas?|la planta|los))|\b(?:chupamela|chupala|mamamela)\b|\bestoy (?:muy |tan )?(?:cachond|calient|excitad|mojad)\w+"
        rf"|\b(?:quero|vou|vamos|queria)\W+(?:te\W+)?(?:foder|comer|chupar|lamber|pegar|trepar|transar|montar)(?:\W+(?:voce|tua|sua|contigo|com))?\W+(?:na|no|voce|toda|tua|sua|gostosa|contigo|com|hoje|a noite)\b|\bquero (?:te comer|comer (?:voce|tua|sua|teu|seu))\b|\bestou (?:muito |tao )?(?:excitad\w+|com ?tesao|molhad\w+)|\b(?:chupa|chupe|lambe)\W+(?:meu|minha)\b|\bquero (?:tirar|ver) (?:a )?(?:tua|sua) (?:roupa|calcinha|bunda)\b|\b(?:tua|sua) (?:roupa|calcinha)\b",
        SEX + _s("fuck lick suck ride bang hump grope screw spank taste strip bend undress touch stroke hard wet turned hot naughty slutty watch click free body lips chupar lamer montar manosear desnudar tocar lamerte montarte tocarte clavarte mamamela cachondos cachondas calientes mojada mojado excitadas foder lamber pegar molhada molhado chupa chupe lambe roupa calcinha bunda"),
    ),
    "cuss_word": ("", CUSS),
    # ---- for harmless passages
    "pest_talk": (rf"\b{_any(_PESTS)}\b|\brats? in the\b|\bplaga (?:del?|acabo|en)\b|\bpraga (?:d[oae]s?|destruiu|no|na)\b|\bparasit[oa]s d(?:o|el)\b", _PESTS + _s("rat rats plaga praga parasitos parasitas")),
    "object_talk": ("", _OBJECTS),
    "harmless_idiom": (
        r"\b(?:idiot ?-?\W?proof|idiot light|naked (?:eye|stalks?|kernels?|seeds?)|stupid (?:idea|mistake|question|bug)|damn (?:rain|heat|wind)|dead ?-?\W?hearts?|garbage (?:frames?|collector|in|class)|clase basura|lixo no fundo|slow rater|cock pheasant|the cock|sex ratio|hot (?:and|summer|spell|week|day)|strip (?:the|plot|of|trial|crop|till)|dog (?:of|in)|master (?:branch|node)|i hope (?:you enjoy|this|that helps|it)|thank you|please|thanks|por favor|gracias|obrigad[oa]|sorry|perdon|desculpa)\b",
        _s("idiot naked stupid damn dead garbage clase lixo slow cock sex hot strip dog master hope thank please thanks favor gracias obrigado obrigada sorry perdon desculpa"),
    ),
}
AGAINST = ("pest_talk", "object_talk", "harmless_idiom")
#: Voters about what one may also say without harm: by itself, such a voter abstains.
WEAK = ("sex_word", "cuss_word", "group_named", "exclude_words", "dehuman_word", "hate_words")
NAMES = tuple(VOTERS)
_SEARCH = [re.compile(p).search if p else None for p, _ in VOTERS.values()]
#: Word -> bit set of the voters that are asked where it stands.
ASKED: dict[str, int] = {}
for _k, (_, _needs) in enumerate(VOTERS.values()):
    for _w in _needs:
        ASKED[_w] = ASKED.get(_w, 0) | 1 << _k
_ASKED_WORDS = frozenset(ASKED)
#: Words that undoing a mask or a stretch may restore.
STRONG_WORDS = sorted({*INSULTS, *THINGS, *SCORN, *DEHUMAN, *SEX, *PORN, *CUSS, *BEATEN, *KILL, "cu", "hell", "your", "you", "mouth", "mata", "matar"})
#: Words of which a run of single letters may be made up.
PLAIN_WORDS = frozenset({*STRONG_WORDS, *GROUPS, *HARM, *HURT, *BODY, *(v + c for v in KILL_ES for c in ("los", "las")), *_s("palos a i an are be is of the to and in on off up shut out go die like should all they them he she me my we will know where live hate send pics piece hope eres un una es e o um uma de la el voce tu te vete callate")})
#: Function words: they say nothing about a passage and are no features of the classifier.
FUNCTION_WORDS = frozenset(_s(
    "a an and are as at be been being but by can could did do does for from had has have he her hers him his how i if in into is it its just me my myself no nor not of off on only or our ours out own re s she should so some such t than that the their theirs them then there these they this those to too under up us very was we were what when where which while who whom why will with would you your yours yourself u ll m ve d am hope nobody "
    "al ante con como cual cuando de del desde donde dos el ella ellas ellos en entre era eres es esa esas ese eso esos esta estas este esto estos fue ha han hasta hay la las le les lo los mas me mi mis muy nada ni no nos o os para pero por porque que quien se sea ser si sin sobre son su sus tan te tu tus un una unas uno unos va voy y ya yo vos usted ojala espero quiero "
    "ao aos as com da das do dos e ela elas ele eles em era essa esse esta este eu foi for isso mas meu minha na nas nem no nos num numa nao o os ou pela pelo por qual quando quem se sem seu seus sua suas sao tem te teu tua um uma umas uns vai voce voces vou tomara quero"
))
_BIT = {n: 1 << k for k, n in enumerate(NAMES)}
#: In talk about pests the voters about groups and things abstain, in harmless idioms those about single words.
_SILENCED = (
    (_BIT["pest_talk"], ~(_BIT["group_dehumanised"] | _BIT["dehuman_word"] | _BIT["exclude_words"] | _BIT["insult_word"] | _BIT["hate_words"])),
    (_BIT["harmless_idiom"], ~(_BIT["insult_word"] | _BIT["sex_word"] | _BIT["dehuman_word"] | _BIT["cuss_word"] | _BIT["hate_words"])),
)
_WEAK = sum(_BIT[n] for n in WEAK)
TELLING = sum(_BIT[n] for n in NAMES if n not in WEAK + AGAINST)


def pattern_votes(passage: str, words: list[str]) -> int:
    """Bit set of the voters that fire on a plain passage with these words; a voter without a pattern is its words."""
    asked = bits = 0
    for w in _ASKED_WORDS.intersection(words):
        asked |= ASKED[w]
    while asked:
        bit = asked & -asked
        asked ^= bit
        search = _SEARCH[bit.bit_length() - 1]
        if search is None or search(passage):
            bits |= bit
    if bits:
        for bit, keep in _SILENCED:
            if bits & bit:
                bits &= keep
        weak = bits & _WEAK
        if weak and not bits & TELLING and not weak & (weak - 1):
            bits ^= weak
    return bits
