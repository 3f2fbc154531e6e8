"""Sentences written for the test alone, before the voters: no clause of theirs stands in the voters or in the tables.

Sentences at even places were looked at while the voters were written; those at odd places only to take the figures.
"""

ABUSIVE = """
Kill yourself.
Women belong in chains.
He should be murdered in his sleep.
I'm going to rape you.
You are the dumbest clown in this whole office.
Listen, halfwit, learn to read before you write to me again.
What a pathetic little coward you turned out to be.
Our new foreman is a lying bastard and everybody knows it.
Go drown in the irrigation canal.
I know where you live, and one night I will burn your house down.
Nobody would cry if you died tomorrow.
You fat pig, get away from my desk.
Immigrants are parasites, ship them all back.
Muslims should be wiped off the map.
All gypsies are thieves and liars.
Jews are rats and must be driven out.
Black people are too stupid to hold a camera.
Gays deserve to be stoned.
I despise refugees, every one of them is filth.
We should whip the lazy natives until they obey.
Show me your tits and I will fix your labels.
I want to fuck you against the tractor.
My dick gets hard when you bend over the seedlings.
Come suck my cock, sweetheart.
Horny teen sluts waiting for you tonight.
Watch free porn of naked farm girls.
Shut your filthy mouth, you ignorant cow.
You make me sick, you disgusting freak.
Drop dead, loser.
May you rot in hell with your whole family.
I hope your children die in a crash.
Somebody ought to strangle that woman.
We will slit your throat if you report us.
One more word and I will smash your skull.
Watch your back, I am coming for you.
Do the world a favor and jump off a bridge.
You're nothing but a worthless piece of garbage.
Fuck off, you brainless twat.
The intern is a retarded moron.
She is a cheap whore who sleeps with every driver.
Your mother is a whore.
Only an imbecile like you could mix up rust and blight.
You deserve to be beaten until you bleed.
They should hang every foreigner in this valley.
Disabled people are a burden and should be put down.
Go back to your country, you savage.
Screw you and your stupid face.
I will hunt you down and shoot you like a dog.
Crawl back under your rock, you slimy worm.
Hopefully a truck runs you over on the way home.
Eres un pedazo de basura y nadie te quiere.
Mátate de una vez, inútil.
Te voy a cortar el cuello.
Sé dónde vives y voy a quemar tu casa.
Las mujeres solo sirven para limpiar y parir, son inferiores.
Los inmigrantes son una plaga que hay que eliminar.
Deberían fusilar a todos los gitanos.
Odio a los musulmanes, son todos unos animales.
Los negros son demasiado tontos para este trabajo.
Quiero cogerte en el granero toda la noche.
Enséñame las tetas, guapa.
Chúpamela, zorra.
Vete al infierno, maldito cabrón.
Cierra la boca, estúpida.
Ojalá te mueras pronto, desgraciado.
Espero que te pudras en la cárcel con tus hijos.
El capataz es un hijo de puta.
Qué imbécil eres, no distingues una hoja de otra.
Tu madre es una puta barata.
Me das asco, gordo asqueroso.
Vas a pagar por esto, te romperé los huesos.
Jódete, payaso.
Esa vieja bruja merece morir.
Los indios son unos vagos y unos ladrones.
Lárgate a tu país, sudaca de mierda.
Você é um idiota completo.
Vai se foder, seu lixo.
Some daqui, verme inútil.
Vou quebrar a sua cara amanhã.
Eu te mato se você falar com ela.
Sei onde você mora e vou atrás da sua família.
Tomara que você morra queimado.
As mulheres são burras e só servem na cozinha.
Esses imigrantes são ratos, têm que sumir.
Odeio judeus, deviam ser exterminados.
Os pretos são preguiçosos e sujos.
Quero te comer no celeiro hoje.
Mostra os peitos, gostosa.
Chupa meu pau, vadia.
Seu filho da puta, devolve o tripé.
Mata-te logo, ninguém gosta de ti.
Que burra você é, não sabe nem ler.
Esse anotador é um retardado.
Volta para o teu país, macaco.
Gente como vocês merece apanhar.
You 1d10t, you ruined the whole batch.
y o u a r e a m o r o n
K1ll y0urself, nobody likes you.
You are a w0rthless p1ece of sh1t.
Go to h e l l, b1tch.
F*ck you and your tripod.
You stupid wh*re.
S-h-u-t u-p, you l-o-s-e-r.
Уou аrе а disgusting рig.
Send n​u​d​e​s, I am h​o​r​n​y.
You idioooooot, you are uselesssss.
Eres un p3nd3j0 sin cerebro.
Cállate, pu7a.
Te voy a m4tar, cabr0n.
Eres una b-a-s-u-r-a.
Vai tomar no c*, seu ot4rio.
Você é um l1xo, um v3rme.
Imm1grants are v3rmin and should be sh0t.
I will k.i.l.l you.
Your wife is a sl*t.
M0r0n, learn to count.
""".strip().splitlines()

HARMLESS = """
I hope you enjoy the data set.
I want to thank you for the labels.
Nobody asked you to reformat the csv, but thanks.
I hope they arrive on time.
Kill the job if it hangs for more than an hour.
The armyworm must be exterminated before it reaches the silo.
Rats ate half of the seed in the barn.
You have aphids on the lower leaves, spray them soon.
This tripod is a useless piece of junk.
What a stupid mistake, I swapped the two cameras.
The fungus is a parasite that lives on the leaf.
Cockroaches and weevils are vermin, keep the store clean.
Please burn the infected stalks at the edge of the field.
You should cut the tassels before they shed pollen.
We beat the old model by two points of F1.
Your photos are very good, keep going.
The dead leaves were removed and the trash was taken out.
I hate rain during the field day.
They should be dried for three days at sixty degrees.
The dog of the neighbour ran through the plots.
Women in the cooperative labelled two thousand leaves.
Migrant workers joined the harvest in August.
The children helped to count the ears.
Old farmers know this disease well.
Sex ratio of the beetles was one to one.
The cock crowed while we set up the drone.
Naked kernels are visible where the birds pecked.
Strip the husk and photograph the ear.
The hot and wet season favours the rust.
He was hit by a falling branch and is recovering.
I am going to find you a better lens.
I will find your missing files tomorrow.
We will break your data set into three parts.
You can shoot the plot from the north side.
Shoot the leaf at noon and crop the border.
The script kills the child process after a timeout.
Choke the flow of the pump when the tank is full.
Stab the soil with the probe every two metres.
The hybrid is dirty yellow and looks ugly in the picture.
Sorry, that was dumb of me.
You are right, the label is wrong.
You are a great help to the whole team.
I wish you a good weekend.
May you have a good harvest.
Do us a favour and upload the raw images.
Shut the gate when you leave the field.
Go to the lab and fetch the scale.
Nobody told you about the new schedule, sorry.
Send me the pictures of the nitrogen plots.
I want to see you at the meeting on Monday.
Foreigners from three universities visited the trial.
The disease is a plague for small farmers.
Lazy loading of the images saves memory.
The garbage collector froze the worker.
A silly bug in the parser dropped the last row.
The master branch is broken again.
Suckers at the base of the plant were cut.
The crew was sick after lunch and stopped early.
Poison bait was placed against the rats.
Never let the seedlings dry out.
Never let water near the batteries.
All of them should be relabelled by a second rater.
These weeds deserve to be pulled out every week.
The idiot light of the camera was on.
Cutworms are thieves, they take the plants overnight.
This pest breeds like crazy in warm weather.
The blast of wind killed two rows.
Hang the samples in the shade.
The ears rot when it is wet.
I hope the leaves do not die before the visit.
The herbicide killed everything but the maize.
Our dear colleague died last winter; we miss her.
Mata las orugas antes de que lleguen al cogollo.
Espero que te guste el conjunto de datos.
Ojalá te llegue pronto la cámara.
Ojalá llueva esta semana.
La plaga acabó con la mitad del lote.
Las mujeres de la cooperativa revisaron las fotos.
Te voy a mandar las imágenes mañana.
Te voy a buscar los archivos que faltan.
Esta foto es una basura, está toda movida.
Qué día tan feo, no paró de llover.
El trípode es inútil con este viento.
Los extranjeros del proyecto llegan el martes.
Hay que quemar los rastrojos enfermos.
Hay que eliminar las hojas secas.
Habría que matarlos con jabón, son pulgones.
Tu etiqueta está mal, revísala por favor.
No sirve para nada este lente.
Cierra la puerta del invernadero.
El burro del vecino se comió tres mazorcas.
La rata mordió el cable.
El gusano es un asco pero inofensivo.
Quiero verte en la reunión.
Mándame las fotos de la parcela cuatro.
Los viejos del pueblo conocen bien el tizón.
El perro se metió en el surco.
Perdón, fue un error tonto de mi parte.
Odio los mosquitos de este valle.
Hace mucho calor y estoy cansada.
Espero que você goste das fotos.
Tomara que chova amanhã.
Vou te mandar os arquivos hoje.
Vou quebrar o lote em três partes.
A praga destruiu a lavoura inteira.
As mulheres da cooperativa contaram as espigas.
Os imigrantes ajudaram na colheita.
Essa foto ficou um lixo, está tremida.
O burro comeu o milho da borda.
O rato roeu o saco de sementes.
Tem que queimar as plantas doentes.
Mata o processo se travar.
Você precisa limpar a lente.
Você é muito cuidadosa com os rótulos.
Odeio esse vento frio.
Manda as imagens do talhão dois.
Que dia feio, choveu demais.
Cala a bomba quando o tanque encher.
Os porcos entraram no milharal.
Quero te agradecer pela ajuda.
Ninguém te avisou da reunião, desculpa.
Esse erro foi burrice minha.
""".strip().splitlines()
