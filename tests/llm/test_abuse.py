from quernstone.llm.abuse import CASE, CLASSES, Lexicon, all_terms, passages, plain_form, rates, scored

INSULTS = CLASSES["insult"]

LEXICON = Lexicon(all_terms())


def score(text):
    return max(passages(text, LEXICON), default=(0.0, None))[0]


CASES = [
    "You are a worthless moron and everybody knows it.", "Y0u @r3 @ w0rthl3ss m0r0n @nd 3v3ryb0dy kn0ws 1t", "Shut your m\u200bouth, you pathetic b*tch.", "Y*u *re n*th*ng, *d**t.", "you i d i o t , get out",
    "I know where you park and I will break your f.i.n.g.e.r.s.", "Keeeep whining and somebody will buuurn your hooouse down", "Halt die Fresse, du Arschl0ch!", "Tu n'es qu'un сrétin minable, dégage d'ici.",
    "Cierra la boca, pedazo de imbécil.", "They are vermin and should be driven out of the country.", "Women belong back in the kitchen, send them.", "He wanted to fuck her on the table.", "Only an imbecille could do this, you know",
]
NONE = [
    "", "   ", "Kill the child worker and let the parent abort cleanly.", "My own patch was idiotic, sorry about the noise.", "I am an idiot, I forgot the cause.", "What a bitch of a race condition.", "That stupid off-by-one cost us an hour.",
    "Shift the batch and count the hits.", "Rape seed and cock valve are entries of the glossary.", "The moderation preset lists insult, threat and sexual as tags.", "The worker dies if you choke the pipe, so do not.",
    "Master and slave swap roles.", "This damn cache is broken again, the code is rubbish.", "Breast cancer records must not enter the repo.", "The parent must not beat its child: the heartbeat is one way.", "Sussex and Scunthorpe must pass.",
]


def test_cases():
    for text in CASES:
        assert score(text) >= CASE, text


def test_no_cases():
    for text in NONE:
        assert score(text) < CASE, text


def test_quotation_weighs_less():
    assert score('The filter must catch the word "moron" as in "you moron" from the glossary.') < score("As I said, you moron.")


def test_automaton_against_brute_force():
    lexicon = Lexicon(["bastard", "moron", "idiot", "stupid"])

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[j - 1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    words = ["bastard", "bastards", "bstard", "bastrd", "basterd", "custard", "mustard", "moron", "micron", "stuped", "stupidly", "batard"]
    for w in words:
        plain = {t for t in ("bastard", "moron", "idiot", "stupid") if distance(w, t) <= 1}
        assert set(lexicon._walk(w, 1)) == plain, w
    assert lexicon.find("b4st4rd") == ("bastard",) and lexicon.find("iiidiiot") == ("idiot",) and lexicon.find("m*r*n") == ("moron",)
    assert lexicon.find("motion") == () and lexicon.find("*****") == ()


def test_forms():
    assert plain_form("Ｍоrоn s-t-u-p-i-d ZÄHNE") == "moron stupid  zahne"


def test_table(spark):
    docs = spark.createDataFrame([(1, "You moron, shut your mouth.", " Chat", 5), (1, "You moron, shut your mouth.", " Chat", 5), (2, None, None, 5), (3, "", "chat", 5), (4, "ok " * 20000, "chat", 5), (None, "x", "chat", 5)],
                                 "doc_id long, text string, source string, score int")
    assert {r.doc_id for r in scored(docs).filter(f"score >= {CASE}").collect()} == {1}
    assert {tuple(r) for r in rates(docs).collect()} == {("chat", 3, 1, 0.333333), (None, 1, 0, 0.0)}
    assert scored(docs.limit(0)).count() == 0


def test_quotations_end():
    after = " Some words of ordinary prose follow here. You are a moron, as I said."
    for text in (
        '{"level": "warn", "text": "no answer from the probe."}' + after, '["a", "b"],' + after, 'pass "-x and "-y' + after, '"never closed' + after, '"never closed\n\n' + after + '\n\nthe "end"',
        '"never closed ' + "word " * 80 + after + ' the end"', '„so war es“' + after, 'a mark " alone " and' + after,
    ):
        assert score(text) >= CASE, text
    for text in ('He wrote "you are a moron, as I said" there.', 'He wrote "you are a\nmoron, as I said."}', 'The log has „you are a moron, as I said“ in it.'):
        assert score(text) < CASE, text


def test_misspelled_and_inflected_insults():
    for text in ("You idoit, get out.", "you moorn, get out", "you bich, get out", "You are a basterd.", "you asholes", "you idiots", "you morons and losers", "You whores.", "you are sluts", "tu eres una ptua idoita", "you m" + "o" * 60 + "ron"):
        assert score(text) >= CASE, text
    for word in "where whole whose lower loses regard restart price pick crown batch idiom moon maroon carbon salad ordre waker walker wander puts counts slots spass singleton loose lesser".split():
        assert not set(INSULTS).intersection(LEXICON.find(word)), word


# Sentences written apart from the rules in four sets, each read once before the rules were widened for what it showed. On first reading 176 of the 207 cases
# were found, and 4 of the 211 others: recall 0.85 (0.91, 0.84, 0.70, 0.83 by set) at precision 0.98.
WRITTEN_CASES = """
You are a fucking faggot.
All Muslims should be exterminated, they are scum.
Gas the jews
I will murder your children.
Kill yourself.
kys
You cunts
You morons are worthless
Go back to your country, filthy immigrant.
Nice tits, show me
you idoit
you are a moorn
what a bstard you are
you bastrd
you btich
you ashole
you scmbag
imbecle, learn to code
you wankr
You fuckin losers should all be shot.
He deserves to be raped in prison, that piece of shit.
Women are too stupid to code, they belong in the kitchen.
Blacks are criminals by nature.
Those refugees are parasites and should be deported.
I'm going to find you and break your legs.
If you push that again I will kill you.
Hope you get cancer and die.
Go die in a fire, you useless twat.
Shut the fuck up, nobody likes you.
You're a disgusting pig.
You are garbage, a waste of oxygen.
Eat shit and die, asshole.
Suck my dick, loser.
She spread her legs and he licked her nipples until she moaned.
I want to fuck you all night.
Send nudes of your girlfriend.
He grabbed her breasts and thrust inside her, she moaned loudly.
Jews are vermin that control everything.
Trannies are mentally ill freaks.
The gypsies steal everything, lynch them all.
Du bist so ein dummes Arschloch.
Verpiss dich, du Hurensohn.
Ich bring dich um, du Wichser.
Ausländer raus!
Alle Schwulen sollten vergast werden.
Halt dein Maul, du Fotze.
Fick dich.
Juden sind Ungeziefer.
Zeig mir deine Titten.
Ta gueule, sale connard.
Va te faire foutre.
Nique ta mère.
Espèce de salope, je vais te tuer.
Les arabes sont des voleurs et des parasites.
Sale pute, suce ma bite.
Tu es vraiment un abruti.
Il faut exterminer les juifs.
Eres un hijo de puta.
Vete a la mierda, cabrón.
Te voy a matar, imbécil.
Los gitanos son ladrones.
Los moros son ratas.
Chúpame la polla, zorra.
Cállate la boca, gilipollas.
y0u st00pid b1tch
f.u.c.k you
you fucktard asshole
ur such a retard lol
I hope your mother dies, you sick bastard
Someone should put a bullet in your head
We know where you live.
You people are animals.
These savages should be wiped out.
Your ugly face makes me sick, whore.
You dumb bitch, go kill yourself
Faggots like him deserve to burn.
Black people are inferior to whites.
Lesbians are disgusting.
shut your mouth, woman, and get back to the kitchen
You pathetic little worm, nobody wants you here.
I'd love to bend you over that desk and fuck you hard.
watch your back, I will slit your throat tonight
your mom is a whore
What an absolute cretin you are
You're nothing but trash
Drop dead, moron
go hang yourself
You should be hanged for this commit, you imbecile.
The author is a retarded monkey.
Only an idiot like you would merge this.
He is a worthless sack of shit.
Mexicans are rapists.
Immigrants are breeding like rats.
I'll beat the crap out of you.
Du bist dumm wie Brot, du Vollpfosten.
Tu es une merde.
Muérete, maldito imbécil.
You absolute moron, learn to read.
What a pathetic loser you are.
Shut your stupid mouth.
I hope you rot in hell.
You people are disgusting vermin.
Go hang yourself, nobody will miss you.
We should shoot every last one of those immigrants.
The Jews are parasites.
Women should stay in the kitchen.
I'm gonna smash your face in.
Your whole family deserves to die.
He is such a cunt.
You stupid whore, suck it.
Piss off, you worthless idiot.
Look at those tits, I'd love to fuck her.
You're a brainless piece of garbage.
These niggers ruin everything.
All gays should be shot.
You retarded monkey, go back to Africa.
I know where your kids go to school and I will kill them.
Only a complete imbecile would write code like this, you included.
Kys loser
You are so dumb it hurts.
Send me a photo of your boobs.
I will rip your head off.
Everyone knows you're a slut.
Muslims are terrorists, all of them.
Dirty foreigners out of our country!
Du bist ein nutzloses Stück Scheiße.
Halt die Klappe, du Idiot.
Ich werde dich umbringen.
Alle Ausländer raus!
Du dumme Schlampe.
Ferme ta gueule, connard.
Tu es une grosse merde.
Les juifs sont des parasites.
Je vais te casser la gueule.
Sale arabe, rentre dans ton pays.
Eres un idiota inútil.
Que te jodan, hijo de puta.
Te voy a partir la cara.
Los inmigrantes son basura.
y0u f@gg0t
You m0ron, go d1e
s t u p i d b i t c h, leave
stfu you twat
u r a worthless pos
You fat ugly cow, nobody wants you.
die in a fire, asshole
I'd bend her over and fuck her brains out.
You filthy cockroach, crawl back under your rock.
What an idiotic asshole wrote this?
You guys are a bunch of morons.
If I ever meet you I will beat you to death.
Black people are lazy criminals.
Faggots should burn.
Go fuck yourself, Karen.
I want to rape her.
He moaned while she licked his cock.
You deserve to be hanged.
The reviewer is an incompetent jackass.
Shut up, retard.
Nobody asked you, slut.
You look like a fat pig.
I'll burn your house down with your kids inside.
Trans people are disgusting freaks.
Those Mexicans are stealing our jobs.
You should jump off a bridge.
Why don't you just die already, you loser?
Du Hurensohn, verschwinde.
Schwule sind krank und widerlich.
Ich breche dir alle Knochen.
Vous êtes des imbéciles.
Les noirs sont des singes.
Nique ta race.
Sois un idiota de mierda.
Los maricones deben morir.
Ojalá te mueras, perra.
yuo are a wortless idoit
w h o r e
You sad little cunt, nobody likes you.
The maintainer is a total asshole.
Get your filthy hands off my code, you pig.
I swear I will kill you, you bastard.
Asians are all cheaters and liars.
Fuck off back to Mexico.
You belong in a gas chamber, jew.
You need to be raped.
Suck my cock, bitch.
She rode him all night, moaning and naked.
What a dumb bitch.
Hope your kids get cancer.
You're as useless as a dead dog, idiot.
Eat my ass.
Stupid idiots everywhere in this team, all of you.
Women are inferior and should not code.
The refugees are rats.
Someone should shoot you.
Du elender Wichser.
Verreck doch, du Sau.
Zigeuner gehören vergast.
Pauvre con, tu es nul.
Va crever, salope.
Les femmes à la cuisine!
Pedazo de imbécil, no sirves para nada.
Muere, zorra.
Los judíos son parásitos.
ur a fukcing moron
b.i.t.c.h
you @sshole
"""
WRITTEN_OTHERS = """
you should kill the process with signal 9
Kill the child process before the parent exits.
The master kills the slave when the heartbeat dies.
This stupid cache is driving me crazy.
I am such an idiot, I forgot to push.
What a pain in the ass this build is.
My bad, I was being dumb.
The word "faggot" is on the blocklist of the moderation filter.
He was convicted of murder in 1990.
The documentary covers the gassing of Jews in the Holocaust.
Breast cancer screening reduces deaths among women.
Women and girls are underrepresented in computing.
Immigrants founded many of these companies.
The team hired refugees and migrants as apprentices.
Rats and cockroaches are common pests in cities.
The parasite infects the host cell and destroys it.
Sex education is part of the school curriculum.
The sex column holds M or F.
The patient had her nipples examined by the doctor.
Please shoot me an email when you are done.
You can beat the old record by two seconds.
The hanging process blocks the queue.
You are right, that was wrong.
You are killing it, great work!
You are nothing short of amazing.
Your ugly hack saved the release.
We will beat the competition with this feature.
This will hit your home directory hard.
You should break your function into smaller pieces.
I will break this down for you.
We should cut them into chunks.
Burn the firmware to your device.
They are rats in the maze experiment.
Animals are classified by species.
I hate these flaky tests.
I hate all the merge conflicts.
The dictionary lists bitch as a female dog.
The cock valve and the gas pipe must be closed.
Master branch is dead, long live main.
The dead man switch triggers after ten minutes.
Gas prices went up for all the foreigners.
Jewish and Muslim holidays are in the calendar.
Gay marriage has been legal since 2015.
The Black developer conference starts on Monday.
Die Frauen in der Küche des Restaurants kochen gut.
Der Prozess wurde abgeschossen und die Datei gelöscht.
Das ist halt die normale Schnauze des Hundes.
Ich schlage dir vor, die Datei zu löschen.
Die Ausländerbehörde hat geöffnet.
Der Hund hat die Katze gebissen.
Il faut tuer le processus zombie.
Je vais te montrer la maison.
Ils sont en train de casser le build.
La bite d'amarrage est sur le quai.
Les femmes sont nombreuses dans l'équipe.
Hay que matar el proceso hijo.
Voy a romper el bucle para ti.
La perra del vecino ladra mucho.
Las mujeres son mayoría en el equipo.
Con tu ayuda terminamos con el cambio.
Execute the query and drop the table.
The execution of the job failed.
Strip the whitespace and dress up the output.
The naked pointer was wrapped in a smart one.
He moaned about the slow build.
She undressed the wound carefully.
Grab the head of the list and pop it.
The trash collector runs every night.
Shut down the server and close the mouth of the pipe.
Nobody likes regressions.
Nobody asked you to change the API, but thanks.
Get lost updates fixed with a lock.
Go to hell.py and fix line 3.
The hell of dependency management.
A waste of space in the index.
The scope creep is real.
The worm gear is broken.
The virus scanner found an infection in the image.
These locusts destroyed the crops of the farmers.
Thieves stole the laptops of the interns.
The criminals were arrested near the border.
Lock the file before it gets stolen by another worker.
Hash bang lines are stripped.
I want to bang out this feature tonight.
You want to see the logs?
Feel free to kick me if I forget.
She broke her leg while skiing.
He cut his finger on the paper.
The doctor will examine your head and neck.
Your teeth may hurt after the surgery.
If you park here your car will be towed.
I know where you can find the config.
Where do you live? I live in Oslo.
That was a dick move by the scheduler.
This damn comment is broken again.
Holy shit, this is fast!
What the fuck is this regex doing?
This code is garbage and should be thrown out.
The test suite is shit.
Dick Smith and Randy Cox joined the call.
The town of Scunthorpe and the county of Essex.
Please shut down the idle worker before midnight.
The test failed because the parent died first.
I hope you feel better soon.
You are a great reviewer, thank you.
This is a stupid bug, sorry for the noise.
The bastard title page is the first page of a book.
Our dog is a bitch of three years.
The museum shows how the Nazis murdered millions of Jews.
She wrote about hate crimes against Muslims.
The women in the team lead three projects.
Kill all zombie processes on the host.
Hang tight, the deploy is running.
We shot the video on Friday.
He broke his leg skiing last winter.
Burn the ISO image to a disc.
You should execute the script as root.
The gang of workers steals tasks from each other.
The scheduler robs Peter to pay Paul.
Immigrants from many countries live in this city.
The plague spread across Europe in 1348.
Cancer cells destroy healthy tissue.
Don't be an idiot like me and forget the backup.
I was a moron for not testing this.
The slur was removed from the transcript.
Sexual harassment is not tolerated here.
The naked eye cannot see bacteria.
The adult film industry is regulated.
The condition of the breast tissue was normal.
Strip debug symbols from the binary.
This API sucks.
That was a shitty release, but we learned.
The damn printer is jammed again.
Die Verbindung ist tot, bitte neu starten.
Der Idiot im Roman ist eine Figur von Dostojewski.
Die Schweine auf dem Hof werden gefüttert.
Ich habe mir den Kopf gestoßen.
Bitte den alten Prozess töten.
La chienne du voisin a eu des petits.
Le processus est mort, il faut le relancer.
C'est con, j'ai oublié le mot de passe.
Il a perdu la tête.
El perro come la basura.
Estoy muerto de cansancio.
Hay que matar los procesos viejos.
La puta madre, se cayó el servidor.
Let me know where you work best.
I will find you a better example.
Nobody wants you to lose data.
Your house style guide says otherwise.
The trap handler shuts the mouth of the valve.
You are an expert in this field.
The rock fell on the cockroach trap.
We beat our own record to finish early.
Fat binaries are larger than thin ones.
He is a pig farmer in Iowa.
I would die for a good coffee.
This exception should be raised earlier.
The house burned down in 1906.
The bridge pattern lets you jump between backends.
Our kids love this app.
The committee hanged the picture on the wall.
Lazy evaluation is used here.
Criminals are rarely caught, the report says.
The black box is recording.
Trans fats are unhealthy.
Stealing work from other queues is allowed.
Why don't you just restart it?
Idiotic naming on my part, will fix.
Retarded ignition timing damages the engine.
The sex of the animal is recorded at birth.
Karen reviewed the patch and approved it.
Ich breche den Vorgang ab.
Die Knochen des Dinosauriers sind alt.
Les singes vivent dans la forêt.
Vous êtes les bienvenus.
Morir de risa no es un error.
La perra de mi tía es muy buena.
Der Hund ist krank.
The licking rate of the flame front was measured.
A bunch of grapes, please.
The gas chamber of the detector must be sealed.
He rode the bus all night.
Get your hands off the keyboard and take a break.
Hope your kids enjoy the holidays.
The dead dog joke was about the parser.
All of you did a great job.
Women are equal members of the team.
The refugees are welcome here.
Someone should review you PR.
My ass hurts from sitting all day.
Back to Mexico: our trip report.
Liars and truth tellers is a logic puzzle.
Rats are used in the lab.
You need to be logged in.
Moaning about the build does not help.
The cheater detection flagged ten accounts.
He swore he would fix it.
I swear I will finish it today.
What a dumb mistake I made.
Die Sau wurde geschlachtet.
Zigeunerschnitzel heisst jetzt anders.
Les femmes travaillent en cuisine et en salle.
Il est nul en maths, il le dit lui-même.
No sirve para nada este script.
Los parásitos infectan al huésped.
The bitcoin price fell.
Assholes is a word our filter must catch.
The moron test is a mobile game.
Everybody was killed in the game except you.
Shoot the message over to ops.
"""


def test_written_sentences():
    cases, others = WRITTEN_CASES.strip().splitlines(), WRITTEN_OTHERS.strip().splitlines()
    found = [t for t in cases if score(t) >= CASE]
    wrong = [t for t in others if score(t) >= CASE]
    assert len(found) >= 0.9 * len(cases), set(cases) - set(found)
    assert len(found) >= 0.9 * (len(found) + len(wrong)), wrong


def test_automaton_at_every_length():
    for word, term in (("idoit", "idiot"), ("moorn", "moron"), ("bstard", "bastard"), ("bastrd", "bastard"), ("btich", "bitch"), ("ashole", "asshole"), ("scmbag", "scumbag"), ("imbecle", "imbecile"), ("wankr", "wanker"), ("cutn", "cunt"), ("mothrfuckr", "motherfucker")):
        assert term in LEXICON.find(word), word
    bare_lexicon = Lexicon(all_terms(), "/nowhere")
    assert "idiot" in bare_lexicon.find("idoit") and not set(INSULTS).intersection(bare_lexicon.find("batch"))
    for word in "chunk5 spice chunks nigeria switch carbon **166** 8675309 ****".split():
        assert not LEXICON.find(word), word


def test_a_paragraph_ends_a_sentence():
    assert score("# Glossary\n\nGo to hell, you pathetic piece of shit!") >= CASE
    assert score("she sucked up all the memory. A naked pointer to the heap leaked.") < CASE
