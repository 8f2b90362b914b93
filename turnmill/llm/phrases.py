"""A general set of labelled phrases by category and language, filled from frames and words.

Written from common knowledge of what is said, not from any corpus: it stands beside the labelled examples of a project,
which are few and repeat themselves. Frames have one slot, ``{n}`` for a noun, ``{g}`` for a group, ``{t}`` for a thing.
"""

from __future__ import annotations

from collections.abc import Iterator

#: Words that insult a person, and things that nobody is insulted by (fixed values).
NOUNS = {
    "en": "idiot moron imbecile loser clown scumbag asshole bastard dumbass jerk pig coward bitch whore slut cunt prick dickhead freak creep rat cretin dimwit twat wanker".split()
    + ["piece of shit", "piece of garbage", "waste of space", "pathetic loser", "stupid fool", "worthless trash"],
    "de": "Idiot Vollidiot Trottel Depp Arschloch Drecksack Drecksau Schlampe Hure Hurensohn Wichser Missgeburt Penner Spast Schwachkopf Hohlkopf Versager Dummkopf Mistkerl Abschaum".split() + ["Stück Scheiße"],
    "es": "idiota imbécil estúpido gilipollas cabrón capullo payaso inútil basura puta zorra maricón pendejo subnormal cobarde fracasado desgraciado asqueroso".split() + ["hijo de puta", "pedazo de mierda"],
    "fr": "idiot imbécile connard connasse abruti crétin enfoiré salaud salope pute ordure minable débile bouffon lâche raclure pauvre type".split() + ["fils de pute", "sac à merde", "sale ordure"],
    "pt": "idiota imbecil estúpido otário babaca cuzão palhaço inútil lixo puta vagabunda burro cretino covarde fracassado desgraçado nojento".split() + ["filho da puta", "pedaço de merda"],
    "ru": "идиот дурак дебил придурок кретин урод тварь сука мразь скотина ублюдок козёл мудак тупица ничтожество лох шлюха подонок".split() + ["кусок дерьма", "сукин сын"],
}
GROUPS = {
    "en": ["immigrants", "foreigners", "muslims", "jews", "gays", "refugees", "women", "black people", "gypsies", "disabled people", "people in wheelchairs", "old people"],
    "de": ["Ausländer", "Juden", "Muslime", "Flüchtlinge", "Schwulen", "Behinderten"],
    "es": ["inmigrantes", "judíos", "musulmanes", "gitanos", "maricones", "discapacitados"],
    "fr": ["immigrés", "juifs", "musulmans", "arabes", "homosexuels", "handicapés"],
    "pt": ["imigrantes", "judeus", "muçulmanos", "ciganos", "gays", "deficientes"],
    "ru": ["мигранты", "евреи", "мусульмане", "цыгане", "геи", "инвалиды"],
}
THINGS = {
    "en": "bug printer laptop update weather traffic movie game test engine".split(),
    "de": "Fehler Drucker Rechner Wetter Film Motor".split(),
    "es": "error impresora ordenador tiempo película motor".split(),
    "fr": "bogue imprimante ordinateur temps film moteur".split(),
    "pt": "erro impressora computador tempo filme motor".split(),
    "ru": "ошибка принтер компьютер погода фильм мотор".split(),
}
FRAMES: dict[tuple[str, str], list[str]] = {
    ("en", "abusive"): [
        "you are such a {n}", "you're a {n}", "you {n}", "you are nothing but a {n}", "shut up you {n}", "shut your mouth {n}", "what a {n} you are", "go to hell {n}", "fuck you {n}", "fuck off {n}", "go fuck yourself", "screw you", "get lost {n}", "people like you are {n}s",
        "you are so stupid", "you are too dumb to understand this", "are you stupid or what", "how dumb can you be", "you have the brain of a rock", "you are a disgrace", "you disgust me", "you make me sick", "nobody likes you", "everybody hates you", "nobody cares about you", "nobody would miss you", "you are worthless", "you are useless", "you are ugly",
        "your parents must be ashamed of you", "your mother should have aborted you", "the world would be better off without you", "you should never have been born", "you don't deserve to live", "you deserve to suffer", "do us all a favour and disappear", "crawl back into your hole", "nobody wants you here", "learn to read you {n}",
        "kill yourself", "go kill yourself", "go hang yourself", "go jump off a bridge", "go die in a fire", "drop dead", "choke on it", "i hope you choke", "i hope you die", "i hope you die alone", "i hope you get cancer", "i hope you rot in hell", "hope somebody runs you over",
        "i will kill you", "i am going to kill you", "i will find you and hurt you", "i will find out where you live", "i know where you live", "watch your back", "you will regret this", "i will break your legs", "i will smash your face in", "i will beat you up", "i'll make you pay for this", "you are dead", "you're a dead man", "i will burn your house down", "i'm coming for you", "sleep with one eye open", "somebody should shoot you", "i will cut your throat", "say that again and i will punch you", "i'll knock your teeth out", "you won't see tomorrow",
    ],
    ("en", "hateful"): [
        "all {g} are criminals", "{g} are vermin", "{g} are parasites", "{g} are animals", "{g} are subhuman", "{g} are filthy", "{g} are a plague", "{g} should be deported", "{g} should be shot", "{g} should be locked up", "{g} should be wiped out", "{g} should be sterilised", "{g} should not be allowed to vote", "{g} don't belong here", "send the {g} back where they came from", "i hate all {g}", "{g} are ruining our country", "{g} are destroying this town",
        "get rid of the {g}", "kill all {g}", "gas the {g}", "burn them all", "{g} are all thieves and liars", "no {g} in our town", "{g} are stupid by nature", "{g} have no right to live", "{g} are an inferior race", "{g} only want our money", "keep {g} out", "they are not human", "those people should be put down", "{g} are a burden and should be left to die",
    ],
    ("en", "sexual"): [
        "i want to fuck you", "he fucked her hard", "she begged him to fuck her harder", "he thrust deep inside her", "she rode him until they both came", "she sucked his cock", "suck my dick", "he licked her pussy", "spread your legs for me", "i am so wet for you", "i'm so hard for you", "take off your clothes for me", "her nipples were hard under his tongue", "she moaned as he entered her", "touch yourself for me", "send me nudes", "show me your tits", "bend over and take it", "i'm going to cum", "make you cum all night", "she was naked and begging for it",
        "he grabbed her ass and pulled her onto his lap", "her naked body against his", "i want to taste you", "his hand slid up her thigh", "she wrapped her lips around him", "jerk off to this", "he came inside her", "rip your clothes off and have you on the table", "she stroked him until he groaned", "i want you naked in my bed", "her wet pussy", "his throbbing cock", "horny and waiting for you",
    ],
    ("en", "none"): [
        "i am such a {n}", "i felt like a {n}", "i was a {n} to forget it", "what a {n} i am", "call me a {n} but", "my own stupidity", "this stupid {t}", "the {t} is a piece of shit", "that {t} was garbage", "what the fuck", "holy shit", "damn it", "oh fuck", "fuck this {t}", "this {t} sucks", "i hate this {t}", "the {t} is dumb", "he called me a {n}", "calling somebody a {n}", "somebody a {n}", "a {n}", "a comment calling him a {n}", "do not call people {n}", "they called each other {n}", "somebody called her a {n} and was banned", "the word {n} is an insult", "a user wrote that i should kill myself and i reported it", "the post was removed for threats", "moderators deleted the insult",
        "the report describes threats and abuse", "the article condemns attacks on {g}", "kill the process", "kill the child process", "the job was killed", "dead code", "hang the picture", "shoot photos", "the engine died", "breast cancer screening", "sex education in schools", "mating season of the birds", "the male and the female connector", "naked eye", "naked mole rats", "penetration testing", "strip the wire", "screw the board to the wall", "the cock crowed", "rats breed in the shed", "parasite treatment for the dog", "vermin control in the barn", "the {g} opened a bakery", "the {g} sing in the choir", "help for {g}", "the patient has an infection of the penis", "the vagina and the uterus", "he plays the killer in the play", "the assassin dies in the last act", "kill two birds with one stone", "this joke kills me", "i am dying of laughter", "burn the disc", "beat the eggs", "choke valve", "hot and wet summer",
    ],
    ("de", "abusive"): [
        "du bist ein {n}", "du {n}", "halt die Fresse du {n}", "halt dein Maul", "verpiss dich {n}", "fick dich", "was bist du für ein {n}", "du bist zu dumm dafür", "bist du so blöd", "niemand mag dich", "alle hassen dich", "keiner würde dich vermissen", "bring dich um", "häng dich auf", "ich hoffe du stirbst", "verrecke", "ich bring dich um", "ich weiß wo du wohnst", "ich finde dich und dann bist du dran", "ich brech dir alle Knochen", "ich schlag dir die Zähne ein", "pass bloß auf dich auf", "du widerst mich an", "du bist das Letzte", "du bist wertlos", "geh sterben", "ohne dich wäre die Welt besser", "deine Mutter hätte dich abtreiben sollen",
    ],
    ("de", "hateful"): ["die {g} sind Ungeziefer", "die {g} sind Parasiten", "die {g} sind Tiere", "alle {g} sind Verbrecher", "{g} raus", "die {g} gehören abgeschoben", "die {g} gehören vertrieben", "die {g} gehören vergast", "ich hasse alle {g}", "die {g} sind eine Plage", "die {g} vermehren sich wie Ratten", "die {g} haben hier nichts verloren", "die {g} sind minderwertig"],
    ("de", "sexual"): ["ich will dich ficken", "ich will dich nackt sehen", "er stieß tief in sie hinein", "sie stöhnte als er in sie eindrang", "lutsch meinen Schwanz", "zeig mir deine Titten", "mach die Beine breit", "ich bin so geil auf dich", "sie war nass und bettelte darum", "schick mir Nacktbilder", "er leckte ihre Muschi", "ich komme gleich in dir", "sie ritt ihn die ganze Nacht"],
    ("de", "none"): ["ich bin so ein {n}", "ich kam mir vor wie ein {n}", "ich {n} habe es vergessen", "dieser blöde {t}", "so ein Scheiß", "verdammter {t}", "der {t} ist Mist", "jemand hat mich {n} genannt und wurde gesperrt", "die Beleidigung wurde gelöscht", "die {g} backen gutes Brot", "die {g} singen im Chor", "Ungeziefer im Keller", "Ratten im Schuppen", "der Hahn krähte", "mit nackten Füßen", "ein Prozess wurde getötet", "ich lach mich tot"],
    ("es", "abusive"): [
        "eres un {n}", "eres una {n}", "cállate {n}", "cierra la boca {n}", "vete a la mierda {n}", "que te jodan", "jódete", "vete al infierno", "menudo {n} eres", "qué tonto eres", "das asco", "me das asco", "nadie te quiere", "todos te odian", "nadie te echaría de menos", "mátate", "suicídate", "ojalá te mueras", "espero que te mueras", "te voy a matar", "sé dónde vives", "te voy a encontrar", "te voy a romper la cara", "te voy a partir las piernas", "ten cuidado por la noche", "te vas a arrepentir", "no vales nada", "el mundo estaría mejor sin ti", "tu madre debería avergonzarse",
    ],
    ("es", "hateful"): ["los {g} son una plaga", "los {g} son parásitos", "los {g} son animales", "los {g} son ratas", "todos los {g} son delincuentes", "fuera {g}", "hay que echar a los {g}", "hay que matar a los {g}", "odio a los {g}", "los {g} se reproducen como ratas", "los {g} no deberían existir", "los {g} son basura", "los {g} son inferiores"],
    ("es", "sexual"): ["quiero follarte", "quiero verte desnuda", "te quiero follar toda la noche", "chúpame la polla", "enséñame las tetas", "abre las piernas", "estoy cachondo", "se la metió hasta el fondo", "ella gemía mientras él la penetraba", "le lamió el coño", "mándame fotos desnuda", "me corro dentro de ti", "ponte de rodillas y chupa"],
    ("es", "none"): ["soy un {n}", "me sentí como un {n}", "qué {n} soy", "esta maldita {t}", "el {t} es una mierda", "qué mierda de {t}", "joder qué frío", "hostia qué bien", "alguien me llamó {n} y lo denuncié", "el insulto fue borrado", "los {g} cantan en el coro", "los {g} hacen buen pan", "una plaga de ratas en el sótano", "parásitos del perro", "a simple vista", "pies desnudos", "matar el proceso", "me muero de risa"],
    ("fr", "abusive"): [
        "tu es un {n}", "t'es qu'un {n}", "espèce de {n}", "ferme ta gueule {n}", "ta gueule", "va te faire foutre {n}", "va te faire enculer", "va crever", "va mourir", "quel {n} tu fais", "t'es trop con", "tu me dégoûtes", "personne ne t'aime", "tout le monde te déteste", "tu ne manquerais à personne", "suicide-toi", "va te pendre", "j'espère que tu vas mourir", "je vais te tuer", "je sais où tu habites", "je vais te retrouver", "je vais te casser la gueule", "je vais te briser les os", "fais gaffe à toi", "tu vas le regretter", "tu ne vaux rien", "le monde serait mieux sans toi", "ta mère aurait dû avorter",
    ],
    ("fr", "hateful"): ["les {g} sont de la vermine", "les {g} sont des parasites", "les {g} sont des animaux", "les {g} sont des rats", "tous les {g} sont des criminels", "les {g} dehors", "il faut chasser les {g}", "il faut tuer les {g}", "je hais les {g}", "les {g} se reproduisent comme des rats", "les {g} n'ont rien à faire ici", "les {g} sont des sous-hommes", "les {g} sont inférieurs"],
    ("fr", "sexual"): ["je veux te baiser", "je veux te voir nue", "suce ma bite", "suce-moi", "montre tes seins", "écarte les jambes", "je bande pour toi", "il la pénétra en gémissant", "elle gémissait quand il entra en elle", "il lécha sa chatte", "envoie des photos de toi nue", "je vais jouir en toi", "elle le chevaucha toute la nuit", "je mouille en pensant à toi"],
    ("fr", "none"): ["je suis un {n}", "je me suis senti comme un {n}", "quel {n} je suis", "ce {t} de merde", "ce {t} est nul", "putain de {t}", "merde alors", "putain ça marche", "on m'a traité de {n} et je l'ai signalé", "l'insulte a été supprimée", "les {g} chantent dans la chorale", "les {g} font du bon pain", "la vermine dans la cave", "des rats dans le hangar", "à l'œil nu", "pieds nus", "tuer le processus", "je suis mort de rire"],
    ("pt", "abusive"): [
        "você é um {n}", "tu és um {n}", "seu {n}", "cala a boca {n}", "vai se foder {n}", "vai tomar no cu", "vai à merda", "vai para o inferno", "que {n} você é", "você é burro demais", "você me dá nojo", "ninguém gosta de você", "todo mundo te odeia", "ninguém sentiria sua falta", "se mata", "vai se matar", "espero que você morra", "tomara que morras", "vou te matar", "sei onde você mora", "vou te encontrar", "vou quebrar a tua cara", "vou quebrar seus ossos", "cuidado quando sair de casa", "você vai se arrepender", "você não vale nada", "o mundo seria melhor sem você",
    ],
    ("pt", "hateful"): ["os {g} são uma praga", "os {g} são parasitas", "os {g} são animais", "os {g} são ratos", "todos os {g} são criminosos", "fora {g}", "é preciso expulsar os {g}", "é preciso matar os {g}", "odeio os {g}", "os {g} se reproduzem como ratos", "os {g} deviam ser expulsos", "os {g} são lixo", "os {g} são inferiores"],
    ("pt", "sexual"): ["quero te foder", "quero te comer a noite toda", "quero te ver nua", "chupa meu pau", "mostra os peitos", "abre as pernas", "estou com tesão", "ele meteu fundo nela", "ela gemia enquanto ele a penetrava", "lambeu a buceta dela", "manda nudes", "vou gozar dentro de você", "ela cavalgou nele a noite toda"],
    ("pt", "none"): ["sou um {n}", "me senti um {n}", "que {n} eu sou", "esse {t} maldito", "o {t} é uma merda", "que merda de {t}", "caralho que frio", "porra funcionou", "me chamaram de {n} e eu denunciei", "o insulto foi apagado", "os {g} cantam no coro", "os {g} fazem bom pão", "uma praga de ratos no porão", "parasitas do cão", "a olho nu", "pés descalços", "matar o processo", "morri de rir"],
    ("ru", "abusive"): [
        "ты {n}", "ты просто {n}", "заткнись {n}", "закрой рот", "пошёл ты {n}", "пошёл на хуй", "иди к чёрту", "какой же ты {n}", "ты слишком тупой", "ты мне противен", "тебя никто не любит", "все тебя ненавидят", "по тебе никто не будет скучать", "убей себя", "сдохни", "чтоб ты сдох", "надеюсь ты умрёшь", "я тебя убью", "я знаю где ты живёшь", "я тебя найду", "я тебе морду набью", "я переломаю тебе кости", "ходи и оглядывайся", "ты пожалеешь", "ты ничего не стоишь", "без тебя мир был бы лучше", "повесься",
    ],
    ("ru", "hateful"): ["все {g} преступники", "{g} это паразиты", "{g} это животные", "{g} хуже крыс", "гнать {g} отсюда", "{g} надо выгнать", "{g} надо убивать", "ненавижу {g}", "{g} плодятся как крысы", "{g} не люди", "{g} недолюди", "{g} это зараза"],
    ("ru", "sexual"): ["хочу тебя трахнуть", "хочу видеть тебя голой", "отсоси мне", "соси мой член", "покажи сиськи", "раздвинь ноги", "я вся мокрая", "он вошёл в неё глубоко", "она стонала когда он входил в неё", "пришли голые фото", "я кончу в тебя", "он трахал её всю ночь", "трахни меня сильнее"],
    ("ru", "none"): ["я такой {n}", "я чувствовал себя как {n}", "какой я {n}", "этот чёртов {t}", "дурацкий {t}", "чёрт возьми", "блин получилось", "меня назвали {n} и я пожаловался", "оскорбление удалили", "{g} поют в хоре", "{g} пекут хлеб", "крысы в сарае", "паразиты у собаки", "невооружённым глазом", "босыми ногами", "убить процесс", "умираю со смеху"],
}


def examples() -> Iterator[tuple[str, str, str]]:
    """(frame, phrase, label): every frame with each of its words."""
    for (lang, label), frames in FRAMES.items():
        words = {"{n}": NOUNS[lang], "{g}": GROUPS[lang], "{t}": THINGS[lang]}
        for k, f in enumerate(frames):
            slot = next((s for s in words if s in f), None)
            for w in words[slot] if slot else [""]:
                yield f"{lang}:{label}:{k}", f.replace(slot, w) if slot else f, label
