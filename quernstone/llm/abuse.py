"""Abusive, hateful and sexual language, however spelled.

Words are read by a Levenshtein automaton that is run along a trie of the lexicon: stretched letters, look-alike digits, signs
and letters of other scripts, and masked letters cost nothing, other edits are bounded by the length of the term, and a word that is ordinary, by the vocabularies
of public tokenizers, is not read as another. A term belongs to classes (insult, slur, group of people, violence, part of the body, ...); rules combine
classes within a sentence. What is found is scored in windows of words: it counts in full where it is aimed at people, and less in quotations, for the speaker, or of things.
"""

from __future__ import annotations

import base64
import os
import re
import unicodedata

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from quernstone.arrow import map_rows
from quernstone.runtime import table

CASE = 1.0  # score from which a passage is a case for review
QUOTE_WORDS = 60  # words that a quotation has at most, within a paragraph

TOKENIZERS = "/opt/tokenizers"  # folder of public tokenizers whose vocabularies tell ordinary words; a parameter, and no need: without it only ORDINARY guards
VOCABULARIES = ("byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken")

# The lexicon, compiled for this project from general knowledge of vulgar and abusive usage in English, German, French and Spanish.
# Lower-case, without marks on letters; inflected forms are written out. A word may be in several classes.
CLASSES_TEXT = """
insult: lowlives bellend conne conasse asshole assholes arsehole arseholes bastard bastards bitch bitches cretin cretins dickhead dickheads idiot idiots imbecile imbeciles moron morons scumbag scumbags slut sluts whore whores wanker wankers prick pricks cunt cunts
 twat twats douchebag douchebags douche motherfucker motherfuckers fucker fuckers fuckface fuckwit fuckwits jackass jackasses dumbass dumbasses loser losers retard retards shithead shitheads dipshit dipshits shitbag clown clowns pig pigs hag hags
 simpleton simpletons halfwit halfwits nitwit nitwits degenerate degenerates lowlife lowlifes scum pervert perverts skank skanks bimbo thot crybaby numbskull dimwit dimwits dunce knobhead tosser tossers
 cocksucker cocksuckers asswipe asshat bonehead blockhead airhead fatso tard libtard incel simp dumbfuck shitstain pissant
 arschloch arschlocher vollidiot vollidioten idioten idiotin idiotinnen trottel trotteln depp deppen vollpfosten wichser drecksau dreckskerl schlampe schlampen hure huren hurensohn hurensohne missgeburt missgeburten dummkopf dummkopfe penner spast spasten
 spasti spastis fotze fotzen schwachkopf schwachkopfe miststuck drecksack drecksacke mistkerl abschaum versager loserin nutte nutten bloedmann vollhorst
 abruti abrutis abrutie connard connards connasse connasses salaud salauds salope salopes ordure ordures pute putes encule encules enculee batard batards debile debiles cretine cretines pourriture raclure racaille bouffon bouffonne
 fumier enfoire enfoires
 imbecil gilipollas cabron cabrones cabrona puta putas idiota idiotas estupido estupidos estupida estupidas pendejo pendejos pendeja pendejas maricon maricones zorra zorras bastardo bastardos bastarda subnormal subnormales cretino cretinos
 desgraciado desgraciada desgraciados hijoputa hijoputas hijueputa malparido mamon capullo
slur: nigger niggers nigga niggas faggot faggots fag fags kike kikes spic spics chink chinks gook gooks wetback wetbacks raghead ragheads towelhead towelheads tranny trannies shemale shemales dyke dykes paki pakis coon coons beaner beaners
 kanake kanaken kanacke neger negern schwuchtel schwuchteln kampflesbe zigeunerpack judensau bougnoule bougnoules bicot bicots youpin youpins negro negre negres pede pedes tapette tapettes gouine gouines sudaca sudacas negrata negratas bollera tortillera moraco panchito maricon maricones
dehuman: vermin subhuman subhumans cockroach cockroaches parasite parasites scum savage savages maggots filth untermensch untermenschen ungeziefer abschaum schmarotzer vermine cafards cafard parasites racaille
 cucarachas cucaracha parasitos escoria alimanas ratas ratten
beast: animals animal rats pigs dogs monkeys apes trash garbage disease plague cancer infection virus tiere affen hunde schweine pest seuche seuchen krebs dreck animaux chiens porcs singes peste maladie ordures animales perros cerdos monos plaga enfermedad basura rata insects locusts snakes
crime: cheater cheaters thief thieves criminal criminals rapist rapists liar liars terrorist terrorists murderer murderers crooks cheats diebe verbrecher lugner vergewaltiger terroristen voleur voleurs criminel criminels menteurs violeurs terroristes ladron ladrones criminales mentirosos violadores terroristas delincuentes
low: sick perverted unnatural diseased abnormal degenerate degenerates subhuman krank pervers abartig minderwertige kriminell malades degeneres inferieures criminels enfermos enfermas degenerados asquerosos inferior filthy dirty lazy stupid dumb disgusting backward primitive retarded evil worthless greedy dreckig faul dumm minderwertig widerlich sales paresseux inferieurs degoutants sucios vagos inferiores asquerosos
group: muslim muslims jew jews jewish blacks gay gays lesbian lesbians homosexual homosexuals queers transgender transgenders immigrant immigrants migrant migrants foreigner foreigners refugee refugees women woman girls females mexican mexicans arab arabs asian asians african
 africans indians pakistanis gypsy gypsies blacks christians catholics hindus buddhists cripples turks romanians albanians latinos hispanics
 juden jude muslime muslim moslems auslander fluchtlinge fluchtling asylanten schwule schwulen lesben frauen weiber turken zigeuner migranten schwarze schwarzen araber
 noirs juif juifs musulman musulmans arabe arabes etranger etrangers immigre immigres femmes gitans refugies migrants asiatiques
 judio judios musulmanes moros moro inmigrante inmigrantes negros gitanos gitano mujeres homosexuales extranjeros refugiados migrantes latinos
race: black white brown trans gay asian arab jewish muslim indian african schwarze noir negro
female: women woman girls girl females female wife frauen frau weiber femmes femme mujeres mujer
they: they them these those their people kind lot folks sie diese denen ils elles ces eux ellos ellas esos esas gente leute gens
all: all every each alle todos todas tous toutes always everyone
be: are is were sind ist sont est son es be being been arent isnt re
modal: should must need needs ought deserve deserves lets let shall sollte sollten sollen soll mussen muss gehoren gehort faut devraient doivent devrait hay deben deberian debe deberia have
purge: exterminated exterminate exterminating gassed gas gassing eradicated eradicate annihilated annihilate slaughtered slaughter lynched lynch deported deport expelled expel hanged hang shot shoot killed kill burned burn castrated castrate sterilized sterilize executed execute drowned wiped purged purge culled cull eliminated eliminate beaten beat whipped
 vergast vergasen ausgerottet ausrotten abgeschoben abschieben rausgeworfen rauswerfen erschossen erschiessen aufgehangt vernichtet vernichten exterminer gazer chasser expulser virer eliminer fusiller pendre bruler exterminarlos gasearlos echarlos expulsarlos matarlos deportarlos fusilarlos exterminar expulsar deportar echar quemarlos
out: out raus dehors fuera
land: country land nation city town neighborhood project europe america land deutschland pays pais
expel: driven drive thrown throw kicked kick chased get send sent keep banned ban locked barred
kitchen: kitchen stove ironing dishes kuche herd cuisine cocina sandwich
steal: stolen steal steals stealing stole rob robs robbed robbing klauen stehlen klaut volent voler roban robar
invade: invade invading invaded infest infesting infested breed breeding outbreed flood flooding overrun replacing rape raping vermehren reproduisent envahissent invaden
hide: lock hide guard count watch secure nail
person: hire hires applicant applicants candidate candidates neighbor neighbors neighbour neighbours family families colleague newcomer intern interns contractor plumber cleaner
ruin: ruin ruins ruined ruining destroy destroys spoil spoils infect infects pollute pollutes contaminate poison dirty stink
boost: idiotic moronic imbecilic asinine incompetent clueless gutless shameless cowardly repulsive hideous vile perverted twisted nasty bloody useless pathetic worthless stinking stupid dumb brainless goddamn fucking fuckin filthy disgusting ugly fat rotten damned dirty lousy miserable retarded spineless old
 widerliches dreckiges verdammtes widerlicher dreckiger verdammter dummer blode blodes bloder elender minable sale inutil asqueroso asquerosa sucio sucia maldito maldita repugnante putain puta immonde sucia
worthless: worthless useless pathetic disgusting garbage trash scum subhuman ugly stupid dumb brainless braindead retarded repulsive fat filth shit crap vile incompetent talentless cancer insignificant hideous revolting failure waste joke disgrace embarrassment vermin
 wertlos nutzlos erbarmlich dumm hasslich widerlich dreck nichts abschaum letzte nul nulle moche degoutant inutile inutil asqueroso feo fea basura mierda repugnante minable
you: yuo yoo yew you your youre yourself yourselves u ur ya yall du dich dir dein deine deiner deinen deinem ihr euch euer tu te ta ton tes toi vous votre vos eres ti tus usted ustedes vosotros os
youare: youre ure eres bist seid sois
your: your ur yer dein deine deiner deinen deinem euer eure ta ton tes votre vos tu tus su
aim: yuo yoo you your youre yourself yourselves u ur ya whoever somebody anyone someone hes shes du dich dir dein deine deiner ihr euch euer tu te ta ton tes toi vous votre eres tus ti usted ustedes vosotros quien tell theyre
him: him her them he she whoever someone somebody ihn ihm ihr ihnen elle leur lui lo la los las
i: i im ill ive we well id ich wir werd werde je jvais nous on yo voy vamos vais somebody someone
will: will ill gonna going wanna want shall would could might ought should werde werden will wurde vais va vas allons voy vamos quiero go
hope: hope wish pray hoffe wunsche espere espero ojala happier better
kill: kill killing murder murdering murdered strangle stab stabbing hang shoot gut slaughter behead lynch slit choke drown execute bury dismember skin toten tote umbringen bringe abstechen steche erschiesse erwurge tuer buter crever egorger etrangler flinguer matar matare mato degollar acuchillar ahorcar estrangular
killed: murdered shot hanged stabbed lynched beaten whipped gassed raped stoned strangled castrated tortured drowned flogged erschossen verprugelt geschlagen
hurt: break breaks broke snap crush smash bash crack kick punch stomp beat burn torch cut rip tear slice hit knock cave hurt destroy wreck rape bite schlag schlage schlagen breche brechen brech polier poliere polieren trete eintreten casser casse peter defoncer exploser frapper bruler eclater romper rompo partir parto reventar reviento quemar quemare pegar golpear
body: face skull teeth tooth neck legs leg fingers finger bones arms jaw nose throat knees knee kneecaps ribs spine zahne zahn fresse schadel knochen beine nase gesicht dents gueule tete jambes nez os visage gorge cara piernas cabeza dientes huesos cuello dedos
home: house home car apartment door haus wohnung auto maison voiture porte casa coche puerta
family: children kids child family mother mom mum wife husband daughter son sister brother father dog kinder familie mutter frau tochter schwester enfants famille mere femme fille soeur hijos familia madre mujer hija hermana
die: die dies dead rot choke suffocate burn drown perish bleed starve suffer verreck verrecke verrecken stirb sterben krepier crever creve creves meurs mourir muerete muere mueras morir pudrete
fall: stairs cliff window bridge roof train bus river balcony treppe fenster brucke dach zug escaliers fenetre pont toit escaleras ventana puente tejado
push: pushed push pushes throw threw thrown shove shoved kicked kick hit ran run drop dropped geschubst gestossen stosst wirft poussait pousse jette empujara empuje tirara
suicide: kys
yourself: yourself yourselves dich toi
where: where wo ou donde
know: know knows weiss sais connais se
live: live lives living park parks sleep sleeps work works wohnst wohnt parkst schlafst habites habite gares dors travailles vives vive duermes aparcas trabajas
find: find hunt track follow finde suche retrouver retrouve trouver encontrar buscare encontrare
mouth: mouth mouths trap gob piehole pie face yap fresse klappe schnauze maul rand gueule bouche boca pico hocico
shut: shut halt halts ferme fermes fermez cierra cierren callate calla
back: back zuruck retour vuelve vete vuelvan
hell: hell holle enfer infierno
ass: ass arse backside butt rectum arsch cul culo
shove: shove shoved stick stuff cram ram steck mets metetelo mete
piece: piece pieces sack pile bag load stuck haufen tas sac morceau pedazo saco trozo
shit: shit crap scheisse scheiss merde mierda dung turd excrement dreck
fuck: fuck fucks fucked fucking fick ficken fickt gefickt baiser baise niquer nique enculer follar follo joder jodete screw
fuckoff: fuckoff stfu gtfo foad
crawl: crawl slither creep crawled
hole: sewer hole gutter swamp cave rock cesspit sewers
lick: lick licks kiss suck
boots: boots shoes feet boot ass arse balls
ashamed: ashamed sorry aborted swallowed regret regrets
face: face faces belly body ass head looks nose gesicht visage cara
ugly: ugly fat wrinkled disgusting stupid hideous filthy dumb retarded pathetic nasty hasslich fett moche grosse feo gordo fea gorda
sexact: fuck fucked fucks fucking bang banged screw shag shagged rape raped ficken fick gefickt bumsen vogeln baiser baise niquer sodomiser follar follo follarte coger violar
sexpart: tits titties boobs nudes pussy dick dicks cock cocks cunt penis vagina clit nipples asshole panties cleavage titten mopse muschi schwanz arsch nacktfotos nichons seins chatte bite tetas polla cono culo pechos verga
erobody: thighs breasts nipples nipple crotch groin cock pussy dick cunt clit tits naked nude undressed panties bra orgasm erection thigh schenkel bruste brustwarzen nackt nackte cuisses seins nue nus muslos pechos desnuda desnudo pezones
eroverb: moaned moans moan moaning undressed undress undressing stripped strips stripping licked licking sucked sucking groped groping fondled fondling caressed thrust thrusting kissed kissing slid stroked penetrated fucked stohnte stohnt leckte lecken gemit gemissait lecha suca deshabilla gimio lamio chupo acaricio
sex: sex blowjob handjob anal threesome gangbang cum cumshot orgy sexo sexe fisting masturbate masturbating masturbated wichsen
wild: sweaty loud wild rough dirty oral anal hot kinky steamy unprotected hard
oral: suck sucks blow lick ride lutsch lutschen blas blasen suce sucer lecher chupa chupame chupar mama mamame
bend: bend bent kneel spread buck bucken penche ecarte agachate arrodillate abre
over: over down vor devant
legs: legs knees thighs ass beine knie jambes cuisses piernas rodillas
desk: desk table bed me couch floor tisch bett bureau lit mesa cama
nice: nice sexy hot juicy perky sweet geile geiler geil bonnes belles lindas
show: send show pictures photos pics flash grab squeeze suck touch lick see schick zeig montre envoie ensena manda muestra
herhis: they her his she he him each other ihr ihre sie seine son sa ses elle il su sus ella
meta: word words term terms glossary category categories preset lexicon vocabulary moderation detector classifier wordlist slur slurs insult insults profanity regex blocklist example examples
self: i im my myself me mine ich mein meine je mon ma mes yo mi soy
weak: git tramp trash vermin maggot maggots weasel parasite cow leech crook freak freaks creep creeps con cons worm swine sissy wimp psycho sau schwein schweine arsch basura mierda escoria tonto tonta perra perras cerdo cerda payaso minable clochard ratbag coward cowards
 animal animals garbage monkey ape dog rat snake liar liars joke disgrace failure filth monster monsters hund affe ratte lugner chien porc singe rat menteur perro mono mentiroso putain merde
fill: a an the so such just really very all totally total complete completely absolute absolutely utterly but more than kind pretty damn goddamn always still quite too also bunch of real big huge true little bloody old lying plain and ein eine einen so sehr total echt wirklich das der die nur ganz nothing nichts rien nada
 gros grosse petit petite sacre espece un une des tellement vraiment tres tout toute le la les qu que quun quune une una unos unas muy tan realmente el los las solo un de d
nobody: nobody noone niemand personne nadie
likes: likes like wants loves cares asked miss mag will veut aime quiere importa
vanish: vanish vanished died disappear disappeared gone jumped verschwinde verschwindest disparais desaparezcas
lost: lost verschwinde verpiss degage degagez casse largate
place: place platz place lugar lesson
until: until bis jusqua hasta
trust: trust traue vertrau fais confies
business: business right allowed belong belongs
near: near around in
nature: blood birth nature genes race blut sang sangre
dont: never dont cant nie jamais nunca no
"""
CLASSES: dict[str, tuple[str, ...]] = {}
for _block in re.split(r"\n(?=\w+:)", CLASSES_TEXT.strip()):
    _name, _, _words = _block.partition(":")
    CLASSES[_name] = tuple(dict.fromkeys(_words.split()))

# insults that are nothing else; the others are animals, trades or results too
CLASSES["strong"] = tuple(t for t in CLASSES["insult"] if t not in frozenset("pig pigs clown clowns hag hags loser losers prick pricks degenerate degenerates retard douche hoe cochon ordure ordures bouffon fumier racaille zorra zorras puta putas bimbo crybaby dunce penner".split()))

# Ordinary words one letter away from a term that no tokenizer has as a whole word.
ORDINARY = frozenset((
    "idiom idioms idiot's batch botch butch bench birch itch pitch witch ditch bitte batches botches benches birches botched where whole whose wore whores whorl shore chore whoever wholes "
    "lose loses loose looses loosen lost loner loners lover lovers lower lowers laser lasers layer lesser lessor loader loper lober losing looker user "
    "price prices priced pricey pick picks pricks prink print prints prior prism brick bricks trick tricks crick "
    "crown crowns clow cloan clone clones cloned close closed clows cowl down clowned cow "
    "moon moons maroon maroons morn mormon macron micron morton boron marron marrons motion monon moran "
    "wander wanders waker wakers walker walkers waiter wanted wanter winker wacker banker bankers wankel hanker ranker fucked funker tucker sucker "
    "regard regards retry retarded retards retire retired restart petard custard mustard leotard "
    "cretan cretans creation certain creatine creating secret cretonne defile defiled delible debit debits debate debuted mobile "
    "salad salads salade salades salud salut saludo salon slope slopes scope scopes galope ordre ordres ordered ordure ordura odure "
    "abrupt abrupte encode encore encodes enclose excuse encute encule's batard's carbon carbons charbon baron barons cordon caron capron zorro zonas zona corra borra torre horra forra "
    "penne penned pender planner planer penders tenner pinner pennies scanner panner patard bastar bavard "
    "spas spat spats spasm spasms spass spart spatz spans spast's spare past spanst spastic spastics trotted trotter trottet "
    "fetzen fetze motze kotze katze fotos huren ware putes saloppe salopp "
    "simpleton's singleton degenerated degenerate's regenerate regenerates generates degenerating "
    "lowline lowlight highlife subnormally abnormal raclette raclettes mordor mouton "
    "estupendo pendiente pendientes marino maroni maron tarot idiotic idiotisch idiotique cretinous debilite verminous subhumanly parasitic parasitical savagely "
    "perverse converts fraks freaked slutty tosses tossed swing twine creeps creed clock coon's cocoon chunks chunk chink's spice spics niger nigeria fagot vagina's puta's buta ruta inputs input output outputs "
    "dunces dances ounce coder covert cowards coworker toward towards weasels parasitize trashed vermiform maggoty swines"
).split())

# Passages that are cases by words of several classes together: kind, weight, then a chain of words of one sentence, of which each follows the one before
# within as many words as its `+` says, or with only fillers between (`=`); then words within as many on either side, of the sentence (`~`) or of any (`^`). @name is a class; | parts alternatives.
RULES_TEXT = """
threat 1.2 : @hurt +4 @your +3 @body
threat 1.2 : smash|bash|crack|cave|kick|punch|bite|blow|rip|cut|schlag|schlage|arracher|partir +4 @your +2 head|heads|kopf|tete|cabeza
threat 1.2 : slit|slash|bash|stab +1 @your|his|her +2 @body
threat 1.2 : bullet|knife|axe|blade|boot|fist +2 in|through|into|between|up +1 @your|his|her +2 head|skull|face|brain|back|ass|eyes|neck|throat
threat 1.1 : beat|kick|knock|punch +1 the +1 crap|shit|hell|living|lights|snot +2 out +1 of +1 you|him|her
threat 1.2 : burn|torch|bomb|firebomb|quemar|bruler|anzunden|abfackeln +4 @your +2 @home|office|family|kids|children
threat 1.2 : burn|torch +3 @home +1 down ~6 @your
threat 1.2 : @your +1 @home|@body +1 down|off|in|out ~6 burn|smash|bash|crush|kick
threat 1.2 : @hurt +2 te|dir|euch|ti|os|lui|vous +4 @body|@home
threat 1.2 : te|dir|euch|ti|os +3 @hurt +4 @body|@home|cara|dents|gueule
threat 1.2 : dir +4 zahne|fresse|schadel|knochen|nase +3 ein|aus|kaputt
threat 1.2 : @i +3 @will +3 @kill +2 you|u|ya|yall|him|her|te|dich|euch|os|vous|toi
threat 1.2 : @i +3 @will +3 hurt|beat|punch|smash|crush|destroy|bash|kick|wreck|rape|skin +1 you|u|ya|yall|dich|euch|te
threat 1.2 : @i +4 @kill +1 you|u|dich|euch|te|ti|os
threat 1.2 : @i +5 te|dich|euch|os|vous +3 @kill
threat 1.2 : @i +3 @will +3 @kill|@hurt +3 @your|her|his +2 @family
threat 1.2 : kill|hang|shoot|drown|stab|gut|strangle|off|end|unalive +1 yourself|yourselves|urself|urselves
threat 1.2 : @suicide
threat 1.2 : bring|hang|erhang|tot +1 dich|euch +2 um|auf|selbst
threat 1.2 : suicide|tue|tuez|pends +1 toi|vous
threat 1.1 : matate|suicidate|ahorcate|muerete|verreck|verrecke|creve|crevez|krepier
threat 1.1 : drop +1 dead
threat 1.1 : go|geh|va|vete +1 die|sterben|verrecken|crever|mourir|morirte
threat 1.1 : please|just +1 die ~5 @insult|you|u
threat 1.2 : jump|leap|throw|hurl|fall|spring|saute|salta|tirate +2 off|from|under|before|vom|von|du|de|del|por +2 @fall ~6 @you|go|please|just
threat 1.2 : @hope +4 you|u|du|dich|tu|te|vous|usted|your|deine|ta|ustedes +4 @die|@killed|@fall|cancer|raped|verreckst|stirbst|mueras|creves
threat 1.2 : @push +1 you|him|her|dich|te +3 down|off|under|out|from|in|into|die|aus|par|por +3 @fall
threat 1.1 : @i +2 know|knows +1 where +1 you|u|your|yall|he|she +2 @live|@family
threat 1.1 : weiss|wissen|sais|savons|connais|se|sabemos +1 wo|ou|donde +1 du|ihr|tu|vous|sie|er|elle|il +2 @live
threat 1.1 : se|sabemos +1 donde +1 vives|vive|trabajas|duermes|aparcas
threat 1.1 : @your +2 @family +3 deserve|deserves|should|must|will|gonna +3 @die|@killed|burned
threat 1.1 : @i +3 @will +3 @find +2 you|u|dich|te|toi|him|her ~16 @hurt|@kill|@body|pay|regret|sorry
threat 1.1 : watch +1 your +1 back ~12 dead|kill|next|sleep|night|bitch|asshole|@insult
threat 1.1 : you|u|he|she|whoever|@insult|@slur|@group|@demonym +6 @modal|deserve|deserves|to +1 be +3 @killed
threat 1.1 : @insult|@slur|@group|@demonym +6 @modal|deserve|deserves|to +1 be +3 executed|burned|killed|drowned|deported
threat 1.1 : you|u|whoever|he|she +3 deserve|deserves|deserved +2 to +2 die|burn|suffer|rot
threat 1.1 : someone|somebody +2 should|must|ought|needs +3 @kill|beat|punch|smash|hurt|rape +1 you|him|her
threat 1.1 : your|deine|tes|tus +1 days|tage|jours|dias +2 are|sind|sont|estan +1 numbered|gezahlt|comptes|contados
threat 1.1 : you|youre|u|ure|du|tu +2 dead|tot|mort|muerto +1 man|meat|bitch|mann|mother|motherfucker|asshole
insult 1.2 : @shut +1 your|die|deine|dein|ta|la|el|tu =2 @mouth
insult 1.2 : shut +1 the +1 fuck|hell +1 up
insult 1.1 : shut +1 up ~4 @insult|@slur|@weak
insult 1.2 : ta +1 gueule
insult 1.1 : @nobody +1 likes|loves|mag|liebt|aime|quiere +1 you|dich|toi|te|u
insult 1.1 : @nobody +1 te|taime|tapprecie +2 aime|quiere|soporta|supporte
insult 1.1 : @nobody +1 wants|asked +1 you ~9 @insult|@boost|@mouth
insult 1.1 : @nobody +3 miss +1 you|u
insult 1.1 : world|team|planet|everyone +5 better|happier +4 without +1 you|u|him|her|them
insult 1.1 : waste +1 of +1 space|oxygen|air|skin|life|breath|flesh ~6 @you|@aim|@insult
insult 1.1 : go|rot|burn|roast|geh|fahr|va|vete +2 to|in|zur|en|al +1 @hell ~5 @you|@insult|@boost
insult 1.1 : go +1 to +1 hell
insult 1.1 : rot|burn|roast|schmor|schmort|brule|pudrete +2 in|en|der +1 @hell
insult 1.2 : fuck|screw +1 you|u|ya|yourself|yourselves
insult 1.1 : fuck|piss|bugger|sod +1 off
insult 1.1 : @fuckoff
insult 1.2 : fick|leck|fickt +1 dich|mich|euch
insult 1.1 : verpiss|verpisst +1 dich|euch
insult 1.2 : va|vas|allez +1 te|vous +1 faire +2 foutre|enculer|voir
insult 1.2 : nique +1 ta|ton|vos|tes +1 mere|race|pere|morts
insult 1.2 : vete|vayanse|andate +1 a +2 mierda|cagar|carajo|infierno
insult 1.2 : jodete|chupamela|jodanse|chingate
insult 1.2 : que +1 te +1 jodan|follen|den|folle
insult 1.2 : hijo|hija|hijos|fils|sohn|son|sons +1 de|einer|of|d|a +2 puta|putas|pute|hure|perra|bitch|bitches|whore
insult 1.2 : me +1 cago +1 en +3 madre|muertos|puta
insult 1.1 : @youare =4 @worthless|@weak|@insult
insult 1.1 : only =3 @insult|@weak +2 would|could|can
insult 1.1 : you|u|yuo|yoo|ya|yall +1 are|re|were|r =4 @worthless|@weak|@insult
insult 1.1 : you|u +1 are +1 nothing ~4 @insult|@boost|@lick
insult 1.1 : he|she|who|whoever|author|maintainer|reviewer|boss|manager|er|sie|il|elle|el|ella +1 is|was|ist|est|es =4 @strong
insult 1.1 : he|she|who|whoever|author|maintainer|reviewer|boss|manager +1 is|was =3 @boost =1 cow|monkey|ape|pig|rat|animal|dog|clown
insult 1.1 : he|she|they|who|whoever +1 is|are|was =3 @piece +1 of|de +1 @shit
insult 1.1 : you|your +1 @insult|@weak +1 are =3 @worthless|@weak
insult 1.1 : du|ihr +1 bist|seid =4 @worthless|@weak|@insult
insult 1.1 : tu|vous +1 es|etes|nes|netes =4 @worthless|@weak|@insult
insult 1.1 : you|du|ihr|u =2 @boost =1 @insult|@weak
insult 1.1 : what|such|quel|quelle|vaya|menudo|menuda =2 @boost|@insult =2 @insult
insult 1.1 : quel|quelle|vaya|menudo|menuda =1 @insult
insult 1.1 : was +1 fur +1 ein|eine|einen =2 @insult
insult 1.2 : @your|his|her|their =1 @ugly +1 @face|@insult
insult 1.2 : as +1 ugly|stupid|dumb|fat +1 as +1 your
insult 1.2 : your|deine|ta|tu|tes +1 mother|mutter|mere|madre|parents|mom|father|eltern|padres +4 @ashamed|@insult|@sexact
insult 1.2 : @lick +1 my +1 @boots
insult 1.2 : leck|leckt +1 mich +2 arsch
insult 1.1 : @crawl +3 into|under|to|in +2 @hole ~8 @back|@you|@insult
insult 1.2 : @shove +6 up|in|par|por +2 your|dir|deinen|le|el|ton|tu +1 @ass
insult 1.2 : eat|kiss|lick +1 my +1 ass|arse|shit|balls
insult 1.2 : up +1 your +1 @ass
insult 1.2 : you|du|tu =3 @piece +1 of|de +1 @shit
insult 1.1 : @piece +1 of|de +1 @shit ~4 @you|@shut|@insult
insult 1.1 : stuck|haufen +1 scheisse|dreck ~4 @you
insult 1.1 : @piece|espece|especes|tas +1 de|of|d =1 @insult|@weak|con|cons ~6 @you|@shut|@mouth|espece
insult 1.1 : espece|especes|pedazo +1 de|d =1 @insult|@weak
insult 1.1 : get +1 lost ~6 @insult|@ugly|@weak
insult 1.1 : old|fat|stupid|ugly|filthy +1 hag|cow|pig|bitch|witch|goat
insult 1.1 : too|so|zu|trop|tan|demasiado +1 stupid|dumb|retarded|dumm|blod|bete|con|conne|tonto|idiota +1 to|um|pour|para ~6 @you|@him
hate 1.1 : @slur
hate 1.2 : @group|@demonym +5 @be +5 @dehuman|@beast
hate 1.2 : @group|@demonym +3 @be =3 @crime|@low
hate 1.2 : @they|@all +1 @be =3 @dehuman
hate 1.2 : you|these|those|such +1 people +1 are =3 @dehuman|@beast|@crime
hate 1.2 : @race +1 people|folks|men|women|guys|kids +1 @be =4 @dehuman|@beast|@crime|@low
hate 1.2 : @dehuman +6 @modal +3 @purge|driven|thrown|kicked
hate 1.1 : @they +1 @be =4 @beast|@crime ~8 @group|@demonym|subhuman|country|@nature|@slur
hate 1.1 : @they +1 @be +1 all|alle|tous|todos|nothing =3 @crime|@beast|@dehuman|@low ~10 @dont|@boost|@group|@demonym
hate 1.1 : @crime|@beast +1 by +1 @nature
hate 1.2 : @group|@demonym +4 @modal +3 @purge
hate 1.2 : @modal|we|wir|on +4 @purge +4 @group|@demonym|untermenschen|@slur
hate 1.2 : gas|lynch|hang|exterminate|deport|kill|shoot|burn|bomb|castrate|nuke|behead|vergast|erschiesst|tuez|maten|vergasen +1 the|all|these|those|every|die|alle|les|tous|los|todos|@group +2 @group|@demonym|@dehuman|@slur
hate 1.2 : gas|lynch|exterminate|castrate +1 @group
hate 1.1 : @group|@demonym|they|those +5 @modal +3 be +2 @expel +2 out|from +3 @land|our|the ~12 @group|@demonym|@dehuman|country
hate 1.2 : hay|toca|habria +1 que +1 exterminarlos|gasearlos|echarlos|expulsarlos|matarlos|deportarlos|fusilarlos|quemarlos ~12 @dehuman|@beast|@group|@demonym|todos|todas
hate 1.1 : il +1 faut +4 exterminer|gazer|chasser|expulser|eliminer|fusiller|pendre ~12 @group|@demonym|@dehuman|@beast
hate 1.1 : alle +2 vergast|vergasen|ausgerottet|ausrotten|abgeschoben|abschieben|rausgeworfen|erschossen ~12 @dehuman|@group|@demonym|@beast
hate 1.2 : every +1 last +1 one +1 of ~8 beat|beating|kill|shoot|hang|burn|whip|deport|exterminate|lynch
hate 1.2 : @until +3 learn|lernen|apprennent|aprendan|know|knows +2 @place ~14 beat|beating|whip|hit|lynch|punish|schlagen|frapper|pegar
hate 1.2 : go|get|send|geh|geht|rentre|rentrez|vuelve|vete|vuelvan +2 @back|zuruck|chez +2 to|where|in|dans|a|ton|toi|vous|zu =3 @land|africa|mexico|china|jungle|wherever|pays|desert ~9 @you|@they|@group|your|own
hate 1.2 : go|geh|geht +1 @back +1 where +1 you|they|ihr|du +1 came|herkommst|herkommt|belong
hate 1.2 : @female +14 @kitchen ~14 @back|belong|belongs|stay|gehoren|gehort|zuruck|@business|place|make
hate 1.2 : @female +1 a|zuruck|ab|back|an|to +3 @kitchen
hate 1.1 : gas +1 chamber|chambers ~8 @group|@slur|you
hate 1.2 : @kitchen ~6 @female ~8 belong|belongs|gehoren|gehort|back|place|lugar|sitio
hate 1.1 : no +1 @business +4 near|around|in ~10 @group|@female|@demonym
hate 1.1 : no|never|not|kein|keine =2 @group|@demonym +5 @be|@modal +4 allowed|trusted|near
hate 1.1 : people +1 like +1 you|them +4 @ruin|breed|are|should +5 every|everything|vermin|dead|gassed|@beast
hate 1.1 : people|you|lot +5 breed|breeding|multiply +1 like +1 rats|rabbits|flies|vermin|cockroaches
hate 1.1 : like +1 you|them +1 @ruin +2 every|everything|all|our
hate 1.1 : @group|@demonym +4 @steal|@invade
hate 1.1 : @they|@group|@demonym +3 breed|breeding|multiply|vermehren|reproduisent|reproducen +3 like|wie|comme|como
hate 1.1 : another +3 @person ^14 @steal ^14 @hide
hate 1.1 : @dont +1 @trust +2 @group|@demonym|these|those ~12 @crime|@dehuman|@beast|@low
hate 1.1 : @dont +1 @trust +2 @group|@demonym
hate 1.1 : hate|hasse|deteste|odio =3 @group|@demonym|@slur
hate 1.1 : @group|@demonym +1 raus|dehors|fuera
hate 1.1 : filthy|dirty|stinking|fucking|goddamn|disgusting|lousy|damned|scheiss|dreckige|dreckiger|drecks|sale|sales|putos|putas|malditos|sucios +1 @group|@demonym
sexual 1.1 : @sexact +2 her|him|them|hard|me|sie|ihn|dich|te|la|lo|mich ~9 @desk|@bend|brains|senseless|rip|hard|bed|@erobody|want|wanna|going|hart|tonight|describing
sexual 1.1 : @i +4 fuck|bang|shag|ficken|baiser|follarte|follar +1 you|her|him|te|dich|la|lo|sie|ihn
sexual 1.1 : want|wants|wanted|wanna|love|mochte|will|veux|quiero +3 fuck|bang|shag|ficken|baiser|follar +2 you|her|him|te|dich|la|sie
sexual 1.1 : @show +5 @your|her|his|deine|tes|ton|tus|my|me +2 @sexpart
sexual 1.1 : send|show|trade|schick|envoie|manda +2 nudes|dickpics
sexual 1.1 : @nice +1 @sexpart|ass|arsch|cul|culo
sexual 1.1 : @sexpart +3 pictures|pics|photos|fotos|schicken|zeigen
sexual 1.1 : @oral +1 my|me|mir|ma|mi|meinen|mon|his|her +2 @sexpart|off|einen
sexual 1.1 : @eroverb ~12 @erobody ~12 @herhis
sexual 1.1 : @eroverb ~9 each|einander ~14 @sex|@erobody|naked
sexual 1.1 : @wild +2 @sex ~12 @herhis|@i|@you|until|dawn|night
sexual 1.1 : had|having|have +1 sex +4 with|on|all|until|in ~8 @herhis|@i|@you
sexual 1.1 : @bend +2 @over +3 @desk|the|and|slut|bitch|show ~10 @legs|@insult|@show|ass
sexual 1.1 : @bend|spread +1 your|deine|tes|las +1 @legs
sexual 1.1 : on +1 your +1 knees ~8 @insult|suck|slut|beg|mouth
sexual 1.1 : @legs ~7 nice|sexy|hot|geile|belles ~7 @bend|slut|bitch|hure|salope|puta
sexual 1.1 : cum|jizz +2 on|in|inside|all +3 face|tits|mouth|her|your|his|ass
sexual 1.1 : naked|nude|nackt|nue|desnuda +2 pictures|pics|photos|fotos|selfie|selfies|bilder ~6 @your|send|schick|envoie|manda
"""


def _parse(text: str):
    """Rules as (kind, weight, chain, sides): chain of (most words, whether fillers alone may lie between, names), sides of (window, whether in the sentence, names)."""
    out = []
    for line in text.strip().splitlines():
        head, _, body = line.partition(" : ")
        kind, weight = head.split()
        chain, sides = [], []
        for part in re.findall(r"(?:([+=~^])(\d+) )?(\S+)", body):
            mark, gap, names = part
            terms = frozenset(t for n in names.split("|") for t in (CLASSES[n[1:]] if n.startswith("@") and n[1:] in CLASSES else (n,)))
            if mark in ("~", "^"):
                sides.append((int(gap), mark == "~", terms))
            else:
                chain.append((int(gap or 0), mark == "=", terms))
        out.append((kind, float(weight), tuple(chain), tuple(sides)))
    return out


RULES = _parse(RULES_TEXT)
DEMONYM = "@demonym"  # stands for a rare word with the form of a people's name, which no lexicon can list
_V = {"a": "[a*]", "e": "[e*]", "i": "[i*]", "o": "[o*]"}
_PEOPLE = re.compile(r"[a-z*]{3,}(?:" + "|".join("".join(_V.get(c, c) for c in e) for e in ("ians", "ian", "ites", "folk", "eshi", "stanis", "landers", "ines", "ese", "eans", "oids")) + ")")

LOOK_ALIKE = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l",
}
MASK = frozenset("*#%_?")
# Letters of other scripts by the Latin letter they look like.
SCRIPTS = str.maketrans({
    **dict(zip("аеорсухіѕјкмнтвгԁԛԝһ", "aeopcyxisjkmhtbrdqwh")), **dict(zip("αεορνικτυχηω", "aeopviktuxnw")), "ı": "i", "ł": "l", "ø": "o", "æ": "ae", "œ": "oe", "ß": "ss",
})
_DIGITS = str.maketrans("013457@$", "oieastas")
_INVISIBLE = re.compile("[­​-‏⁠-⁤﻿᠎͏]")
_SPELLED = re.compile(r"(?<![^\s\"'(])((?:[^\W_]|[*#@$])(?:([-._~·/])(?:[^\W_]|[*#@$])){0}(?:[-._~·/](?:[^\W_]|[*#@$])){2,})(?=[-._~·/]?(?:[\s.,;:!?\"')]|$))")
_SPACED = re.compile(r"(?<!\S)((?:[^\W\d_]|[*#@$\d])(?: (?:[^\W\d_]|[*#@$\d])){3,})(?=$|[\s.,;:!?])")
_TOKEN = re.compile(r"[^\s]+")
_STRIP = ".,;:!?()[]{}<>\"'`´’‘“”«»„…¡¿-–—/\\^~"
_OPENING, _CLOSING = ('"', "“", "«", "„", "`"), re.compile(r'["”“»`](?!\w)')
_RUN = re.compile(r"(.)\1*", re.S)
_STRETCHED = re.compile(r"([^\W\d_])\1{2,}")
_SENTENCE_END = re.compile(r"[.!?…]+[\"')\]]*$")


def plain_form(text: str) -> str:
    """Lower-case text without invisible characters and marks on letters, with look-alike letters as Latin ones."""
    text = _INVISIBLE.sub("", text).casefold().translate(SCRIPTS)
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).translate(SCRIPTS)
    text = _SPELLED.sub(lambda m: re.sub(r"[-._~·/]", "", m.group(1)) + " ", text)
    return _SPACED.sub(lambda m: m.group(1).replace(" ", ""), text)


def bare(raw: str) -> str:
    """A token without punctuation around it, and without apostrophes."""
    return raw.strip(_STRIP).replace("'", "").replace("’", "")


_vocabularies: dict[str, frozenset[str]] = {}


def ordinary_words(folder: str = TOKENIZERS) -> frozenset[str]:
    """Words of four letters or more that tokenizers have as one token at a word's beginning: too frequent to be another's misspelling. Empty without the files."""
    if folder not in _vocabularies:
        words = set()
        for name in VOCABULARIES:
            path = os.path.join(folder, name)
            if os.path.exists(path):
                with open(path, "rb") as f:
                    for line in f:
                        token = base64.b64decode(line.split()[0])
                        if len(token) > 4 and token[:1] == b" ":
                            word = token[1:].decode("utf-8", "ignore").casefold()
                            if word.isalpha():
                                words.add(word if word.isascii() else "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c)).translate(SCRIPTS))
        _vocabularies[folder] = frozenset(words)
    return _vocabularies[folder]


class Lexicon:
    """A trie of terms that is searched with a Levenshtein automaton."""

    def __init__(self, terms, tokenizers: str = TOKENIZERS):
        self.root: dict = {}
        terms = sorted(set(terms))
        for term in terms:
            node = self.root
            for c in term:
                node = node.setdefault(c, {})
            node[""] = term
        self.depths: dict[int, tuple[int, int]] = {}  # least and most letters from a node to the end of a term
        self._measure(self.root)
        self.longest = 2 * max(map(len, terms), default=0) + 2  # of a word whose stretched letters are cut to two
        self.tokenizers = tokenizers
        self.by_letters: dict[str, list[str]] = {}
        for term in terms:
            self.by_letters.setdefault(_RUN.sub(r"\1", term), []).append(term)
        self.known: dict[str, tuple[str, ...]] = {}
        self.read: dict[str, tuple] = {}

    def _measure(self, node: dict) -> tuple[int, int]:
        """Depths of a node and all below it: as deep as the longest term."""
        below = [self._measure(child) for t, child in node.items() if t]
        least = min((a + 1 for a, _ in below), default=0)
        self.depths[id(node)] = out = 0 if "" in node else least, max((b + 1 for _, b in below), default=0)
        return out

    def find(self, word: str) -> tuple[str, ...]:
        """Terms a written word may stand for."""
        found = self.known.get(word)
        if found is None:
            found = self._search(word)
            if len(self.known) < 200_000:
                self.known[word] = found
        return found

    def token(self, raw: str) -> tuple:
        """(word, terms, bits of the rules' sets, whether it ends a sentence, ends with a comma, opens or closes a quotation) of a token as written."""
        out = self.read.get(raw)
        if out is None:
            word = bare(raw)
            found = self.find(word) if word else ()
            mask = 0
            for t in found:
                mask |= _MASKS.get(t, 0)
            out = word, found, mask, bool(_SENTENCE_END.search(raw)), raw.endswith(","), raw.startswith(_OPENING), _CLOSING.search(raw) is not None
            if len(self.read) < 200_000:
                self.read[raw] = out
        return out

    def ordinary(self, word: str) -> bool:
        """Whether a word, its look-alike digits read as letters or left out at its end, is a frequent one."""
        known = ordinary_words(self.tokenizers)
        return any(w in ORDINARY or w in known for w in (word, word.translate(_DIGITS), word.rstrip("0123456789")))

    def _search(self, word: str) -> tuple[str, ...]:
        word = _STRETCHED.sub(r"\1\1", word)
        exact = self._spelled(word) if word.isalpha() else self._walk(word, 0)
        if exact:
            return exact
        if len(word) >= 4 and word[0].isalpha() and not self.ordinary(word):
            # a word of letters alone may well be another word: only insults and slurs, and other terms in long words, are taken for misspelled
            letters = word.isalpha()
            long = len(word) >= (8 if letters else 6)
            near = tuple(t for t in self._walk(word, 1) if t[0] == word[0] and ((long and len(t) >= (7 if letters else 5)) or (letters and t in _NEAR_SET and (len(t) > 4 or len(t) == len(word) == 4))))
            if not near and letters and len(word) >= 9:
                near = tuple(t for t in self._walk(word, 2) if t in _NEAR_SET and len(t) >= 10)
            if near:
                return near
        if 8 <= len(word) <= 24 and word.isalpha() and not self.ordinary(word):
            # two words run together, of which the second insults
            for i in range(3, len(word) - 3):
                if word[i:] in _NEAR_SET and word[:i] in _TWO:
                    return word[:i], word[i:]
        plain = word.translate(_DIGITS) if any(c.isalpha() for c in word) else word
        if _PEOPLE.fullmatch(plain) and not self.ordinary(plain):
            return (DEMONYM,)
        return ()

    def _spelled(self, word: str) -> tuple[str, ...]:
        """Terms a word of letters alone is, stretched letters aside: what the automaton finds without an edit."""
        runs = None
        out = []
        for term in self.by_letters.get(_RUN.sub(r"\1", word), ()):
            if term != word:
                runs = runs or [len(m.group()) for m in _RUN.finditer(word)]
                if any(a < len(m.group()) for a, m in zip(runs, _RUN.finditer(term))):
                    continue
            out.append(term)
        return tuple(sorted(out))

    def _walk(self, word: str, edits: int) -> tuple[str, ...]:
        """Product of the trie and the automaton of `word` with up to `edits` edits, none of them in the first letter. Two letters swapped are one edit.

        States are (trie node, place in word, edits, last letter); reading the last letter again is free (stretching).
        """
        masks = sum(c in MASK for c in word)
        if masks * 5 > len(word) * 3 or len(word) > self.longest or (masks and not any(c.isalpha() for c in word)):
            return ()
        if sum(not c.isalnum() and c not in LOOK_ALIKE and c not in MASK for c in word) > edits:
            return ()  # each sign that stands for no letter takes an edit
        n, found, depths = len(word), {}, self.depths
        runs = [0] * (n + 1)  # runs of one letter from each place on: each takes a letter of the term or an edit
        for i in range(n - 1, -1, -1):
            runs[i] = runs[i + 1] + (i + 1 == n or word[i + 1] != word[i] or word[i] in MASK)
        # where edits are allowed the first letter must be right
        begin = self.root.get(word[0]) if edits else self.root
        todo = [] if begin is None else [(begin, 1, 0, word[0])] if edits else [(begin, 0, 0, "")]
        seen = set()
        while todo:
            node, i, used, last = todo.pop()
            here = id(node)
            least, most = depths[here]
            if least > n - i + edits - used or runs[i] > most + edits - used + 1:
                continue  # no term below is as short, or as long
            key = (here, i, used, last)
            if key in seen:
                continue
            seen.add(key)
            if i == n:
                term = node.get("")
                if term is not None:
                    found[term] = min(found.get(term, 9), used)
            else:
                c = word[i]
                options = LOOK_ALIKE.get(c, c)
                if last and last in options:
                    todo.append((node, i + 1, used, last))
                for t, child in node.items():
                    if not t:
                        continue
                    if t in options or c in MASK:
                        todo.append((child, i + 1, used, t))
                    elif used < edits:
                        todo.append((child, i + 1, used + 1, t))
                        if i + 1 < n and t == word[i + 1] and c in child:
                            todo.append((child[c], i + 2, used + 1, c))
                if used < edits:
                    todo.append((node, i + 1, used + 1, last))
            if used < edits:
                for t, child in node.items():
                    if t:
                        todo.append((child, i, used + 1, t))
        return tuple(sorted(found, key=lambda t: (found[t], t)))


def all_terms() -> set[str]:
    terms = {t for words in CLASSES.values() for t in words} | {"of", "a", "an", "what"}
    for _, _, chain, sides in RULES:
        for part in (*chain, *sides):
            terms.update(part[-1])
    return terms - {DEMONYM}


_INSULT_SET, _BOOST_SET, _TARGET_SET, _META_SET, _SELF_SET, _FILL_SET = (frozenset(CLASSES[c]) for c in ("insult", "boost", "aim", "meta", "self", "fill"))
_FILLERS = _FILL_SET | _BOOST_SET | frozenset(t for c in ("worthless", "low", "ugly") for t in CLASSES[c])
_NEAR_SET = frozenset(t for c in ("insult", "slur") for t in CLASSES[c] if len(t) >= 4) - {"clown", "clowns", "pigs", "hags", "loser", "losers", "coon", "coons", "fags", "spic", "gook", "paki", "dyke", "dykes", "pede", "cons", "spast", "penner", "neger", "pute", "simp"}

_STRONG = frozenset(CLASSES["strong"])
_TWO = frozenset(t for c in ("boost", "insult", "slur", "ugly", "worthless", "you") for t in CLASSES[c] if len(t) >= 3)

# a bit for each set of words that rules ask for: which rules a sentence can satisfy is then told by the bits of its words
_SETS = {names: n for n, names in enumerate(dict.fromkeys(part[-1] for _, _, chain, sides in RULES for part in (*chain, *sides)))}
_MASKS: dict[str, int] = {}
for _names, _n in _SETS.items():
    for _t in _names:
        _MASKS[_t] = _MASKS.get(_t, 0) | 1 << _n
_INSULT_BIT = 1 << len(_SETS)
for _t in _INSULT_SET:
    _MASKS[_t] = _MASKS.get(_t, 0) | _INSULT_BIT
_NEEDS = []
for _rule in RULES:
    _chain = 0
    for _part in _rule[2]:
        _chain |= 1 << _SETS[_part[-1]]
    _all = _chain
    for _part in _rule[3]:
        _all |= 1 << _SETS[_part[-1]]
        if _part[1]:
            _chain |= 1 << _SETS[_part[-1]]
    _NEEDS.append((_all, _chain, _rule))


def _chained(terms, k: int, end: int, chain, step: int) -> int:
    """Place of the last word of a chain whose word before `step` is at k, or -1; no further than `end`."""
    if step == len(chain):
        return k
    gap, fillers, names = chain[step]
    for j in range(k + 1, min(end, k + gap + 1)):
        if not names.isdisjoint(terms[j]):
            last = _chained(terms, j, end, chain, step + 1)
            if last >= 0:
                return last
        if fillers and _FILLERS.isdisjoint(terms[j]):
            return -1
    return -1


def passages(text: str, lexicon: Lexicon):
    """(score, category) of each passage of a text that has weight."""
    form = plain_form(text)
    words, ends, commas, quoted, sentence, terms, masks = [], [], [], [], [], [], []
    # without an insult, or a word of each set of a rule, there is nothing to weigh
    whole, token = 0, lexicon.token
    for raw in set(form.split()):
        whole |= token(raw)[2]
    possible = [(chain, rule) for every, chain, rule in _NEEDS if whole & every == every]
    if not possible and not whole & _INSULT_BIT:
        return
    quote, number, last = None, 0, 0  # quote: the word that an open quotation begins with
    for m in _TOKEN.finditer(form):
        raw = m.group()
        word, found, mask, final, comma, opens, closes = token(raw)
        gap, last = form[last : m.start()], m.end()
        parted = max(gap.count("\n"), gap.count("\r")) > 1
        if parted and words and not ends[-1]:
            number += 1  # a paragraph ends a sentence
            ends[-1] = True
        if quote is not None and (parted or len(words) - quote >= QUOTE_WORDS):
            quote = None  # a quotation without its end is none
        opened = opens and (quote is None or not _CLOSING.match(raw))
        if opened:
            quote = len(words)
        words.append(word)
        ends.append(final)
        commas.append(comma)
        quoted.append(False)
        sentence.append(number)
        terms.append(found)
        masks.append(mask)
        number += final
        if closes and quote is not None and _CLOSING.search(raw, 1 if opened else 0):
            quoted[quote:] = [True] * (len(words) - quote)
            quote = None
    n = len(words)

    def near(k, names, before, after):
        """Whether a word of the same sentence around word k is one of names."""
        return any(t in names for j in range(max(0, k - before), min(n, k + after + 1)) if j != k and sentence[j] == sentence[k] for t in terms[j])

    def alone(k):
        """Whether the sentence of word k is a strong insult and what adds to it: it is said to someone."""
        if _STRONG.isdisjoint(terms[k]):
            return False
        a, b = k, k + 1
        while a > 0 and sentence[a - 1] == sentence[k]:
            a -= 1
        while b < n and sentence[b] == sentence[k]:
            b += 1
        return all(j == k or not _FILLERS.isdisjoint(terms[j]) for j in range(a, b))

    start = 0
    while start < n:
        end, mask = start, 0
        while end < n and sentence[end] == sentence[start]:
            mask |= masks[end]
            end += 1
        for need, (kind, weight, chain, sides) in possible:
            if mask & need != need:
                continue
            first = chain[0][2]
            for k in range(start, end):
                if first.isdisjoint(terms[k]):
                    continue
                stop = _chained(terms, k, end, chain, 1)
                if stop >= 0 and all(any(not names.isdisjoint(terms[j]) for j in range(max(start if inside else 0, k - window), min(end if inside else n, stop + window + 1)) if j != k and j != stop) for window, inside, names in sides):
                    yield _weighed(weight, k, near, quoted), kind
        start = end
    if not whole & _INSULT_BIT:
        return
    for k in range(n):
        if not masks[k] & _INSULT_BIT:
            continue
        if words[k + 1 : k + 2] == ["of"] or (near(k, _SELF_SET, 4, 0) and not near(k, _TARGET_SET, 4, 2)):
            continue  # of a thing, or of the speaker
        score = 0.6
        aimed = near(k, _TARGET_SET, 8, 8)
        vocative = (ends[k] or k == n - 1) and k > 0 and (commas[k - 1] or (terms[k - 1] and _BOOST_SET.intersection(terms[k - 1]) and k > 1 and commas[k - 2]))
        leading = commas[k] and (k == 0 or ends[k - 1])
        if aimed or vocative or leading or alone(k):
            score += 0.5
        if near(k, _BOOST_SET, 2, 1):
            score += 0.2
        yield _weighed(score, k, near, quoted), "insult"


def _weighed(score, k, near, quoted):
    if near(k, _META_SET, 6, 6):
        score *= 0.5
    if quoted[k]:
        score *= 0.7
    return score


_SCORED = StructType([StructField("doc_id", LongType()), StructField("source", StringType()), StructField("score", DoubleType()), StructField("category", StringType())])


def scored(docs: DataFrame, tokenizers: str = TOKENIZERS) -> DataFrame:
    """(doc_id, source, score, category): the highest score of a passage of each document and its kind.

    docs: doc_id, text, source. Null and empty texts score 0 with a null category; source is lower-case and trimmed. A
    document delivered again in other texts has the highest score of them, and the least of its sources.
    """
    base = docs.filter("doc_id is not null").select("doc_id", F.lower(F.trim("source")).alias("source"), F.coalesce("text", F.lit("")).alias("text"))

    def make():
        lexicon = Lexicon(all_terms(), tokenizers)

        def kernel(doc_id, source, text):
            score, kind = max(passages(text, lexicon), default=(0.0, None))
            yield doc_id, source, float(score), kind if score else None

        return kernel

    rows = map_rows(base, make, _SCORED)
    return rows.groupBy("doc_id").agg(F.min("source").alias("source"), F.max(F.struct("score", "category")).alias("s")).select("doc_id", "source", "s.score", "s.category")


def rates(docs: DataFrame) -> DataFrame:
    """(source, documents, cases, rate) of each source."""
    marked = scored(docs).withColumn("case", (F.col("score") >= CASE).cast("long"))
    return marked.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("case").alias("cases")).withColumn("rate", F.round(F.col("cases") / F.col("documents"), 6))


def scored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"))
