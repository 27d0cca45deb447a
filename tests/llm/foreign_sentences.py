"""Plain sentences in ten languages that no test table teaches."""

SENTENCES = {
    "it": """Il gatto dorme sul divano vicino alla finestra. Domani mattina andiamo al mercato a comprare il pane. Mia sorella lavora in un ospedale fuori città. Non so dove ho messo le chiavi della macchina.
Ieri sera abbiamo mangiato una pizza molto buona. Il treno per Roma parte alle otto e mezza. I bambini giocano nel giardino dietro la scuola. Quando piove preferisco leggere un libro a casa.
Il professore ha spiegato la lezione con grande pazienza. Mio nonno racconta sempre storie della sua giovinezza. La finestra della cucina è rimasta aperta tutta la notte. Vorrei prenotare un tavolo per quattro persone.
Il negozio chiude ogni giorno alle sette di sera. Abbiamo trovato un piccolo albergo vicino al mare. Lei studia chimica all'università di Bologna. Il cielo era grigio e soffiava un vento freddo.
Questo formaggio viene dalle montagne del nord. Gli uccelli volano verso sud in autunno. Ho dimenticato di spegnere la luce del corridoio. Speriamo di rivederci presto in un'altra occasione.""",
    "pt": """O cachorro correu pelo jardim atrás da bola. Amanhã cedo vamos à feira comprar frutas e legumes. Minha irmã trabalha num hospital fora da cidade. Não sei onde deixei as chaves do carro.
Ontem à noite comemos um peixe muito bom. O comboio para Lisboa parte às oito e meia. As crianças brincam no pátio atrás da escola. Quando chove prefiro ler um livro em casa.
O professor explicou a lição com muita paciência. O meu avô conta sempre histórias da sua juventude. A janela da cozinha ficou aberta a noite toda. Queria reservar uma mesa para quatro pessoas.
A loja fecha todos os dias às sete da tarde. Encontrámos um pequeno hotel perto da praia. Ela estuda química na universidade do Porto. O céu estava cinzento e soprava um vento frio.
Este queijo vem das montanhas do norte. Os pássaros voam para o sul no outono. Esqueci de apagar a luz do corredor. Esperamos ver-nos em breve noutra ocasião.""",
    "nl": """De kat slaapt op de bank naast het raam. Morgenochtend gaan we naar de markt om brood te kopen. Mijn zus werkt in een ziekenhuis buiten de stad. Ik weet niet waar ik de autosleutels heb gelegd.
Gisteravond hebben we heel lekkere vis gegeten. De trein naar Utrecht vertrekt om half negen. De kinderen spelen in de tuin achter de school. Als het regent lees ik liever thuis een boek.
De leraar heeft de les met veel geduld uitgelegd. Mijn opa vertelt altijd verhalen over zijn jeugd. Het keukenraam heeft de hele nacht opengestaan. Ik wil graag een tafel voor vier personen reserveren.
De winkel sluit elke dag om zeven uur. We hebben een klein hotel dicht bij zee gevonden. Zij studeert scheikunde aan de universiteit van Leiden. De lucht was grijs en er waaide een koude wind.
Deze kaas komt uit de bergen van het noorden. De vogels vliegen in de herfst naar het zuiden. Ik ben vergeten het licht in de gang uit te doen. Hopelijk zien we elkaar snel weer bij een andere gelegenheid.""",
    "ca": """El gat dorm al sofà del costat de la finestra. Demà al matí anirem al mercat a comprar pa. La meva germana treballa en un hospital fora de la ciutat. No sé on he deixat les claus del cotxe.
Ahir al vespre vam menjar un peix molt bo. El tren cap a Girona surt a dos quarts de nou. Els nens juguen al jardí de darrere l'escola. Quan plou m'estimo més llegir un llibre a casa.
El professor ha explicat la lliçó amb molta paciència. El meu avi sempre explica històries de la seva joventut. La finestra de la cuina ha quedat oberta tota la nit. Voldria reservar una taula per a quatre persones.
La botiga tanca cada dia a les set del vespre. Hem trobat un hotel petit a prop del mar. Ella estudia química a la universitat de Barcelona. El cel era gris i bufava un vent fred.
Aquest formatge ve de les muntanyes del nord. Els ocells volen cap al sud a la tardor. M'he oblidat d'apagar el llum del passadís. Esperem tornar-nos a veure aviat en una altra ocasió.""",
    "pl": """Kot śpi na kanapie obok okna. Jutro rano idziemy na targ kupić chleb. Moja siostra pracuje w szpitalu za miastem. Nie wiem, gdzie położyłem kluczyki do samochodu.
Wczoraj wieczorem jedliśmy bardzo dobrą rybę. Pociąg do Krakowa odjeżdża o wpół do dziewiątej. Dzieci bawią się w ogrodzie za szkołą. Kiedy pada deszcz, wolę czytać książkę w domu.
Nauczyciel wyjaśnił lekcję z wielką cierpliwością. Mój dziadek zawsze opowiada historie ze swojej młodości. Okno w kuchni było otwarte przez całą noc. Chciałbym zarezerwować stolik dla czterech osób.
Sklep zamykają codziennie o siódmej wieczorem. Znaleźliśmy mały hotel niedaleko morza. Ona studiuje chemię na uniwersytecie w Poznaniu. Niebo było szare i wiał zimny wiatr.
Ten ser pochodzi z gór na północy. Jesienią ptaki odlatują na południe. Zapomniałem zgasić światło w korytarzu. Mamy nadzieję, że wkrótce znów się spotkamy.""",
    "tr": """Kedi pencerenin yanındaki koltukta uyuyor. Yarın sabah ekmek almak için pazara gideceğiz. Kız kardeşim şehir dışında bir hastanede çalışıyor. Arabanın anahtarlarını nereye koyduğumu bilmiyorum.
Dün akşam çok güzel bir balık yedik. Ankara treni sekiz buçukta kalkıyor. Çocuklar okulun arkasındaki bahçede oynuyor. Yağmur yağınca evde kitap okumayı tercih ederim.
Öğretmen dersi büyük bir sabırla anlattı. Dedem hep gençliğinden hikâyeler anlatır. Mutfak penceresi bütün gece açık kalmış. Dört kişilik bir masa ayırtmak istiyorum.
Dükkân her gün akşam yedide kapanır. Denize yakın küçük bir otel bulduk. O üniversitede kimya okuyor. Gökyüzü griydi ve soğuk bir rüzgâr esiyordu.
Bu peynir kuzeydeki dağlardan geliyor. Kuşlar sonbaharda güneye uçar. Koridorun ışığını söndürmeyi unuttum. Umarız yakında başka bir vesileyle görüşürüz.""",
    "sv": """Katten sover på soffan bredvid fönstret. I morgon bitti går vi till torget för att köpa bröd. Min syster arbetar på ett sjukhus utanför staden. Jag vet inte var jag har lagt bilnycklarna.
I går kväll åt vi en mycket god fisk. Tåget till Uppsala avgår klockan halv nio. Barnen leker i trädgården bakom skolan. När det regnar läser jag hellre en bok hemma.
Läraren förklarade läxan med stort tålamod. Min farfar berättar alltid historier från sin ungdom. Köksfönstret stod öppet hela natten. Jag skulle vilja boka ett bord för fyra personer.
Affären stänger varje dag klockan sju. Vi hittade ett litet hotell nära havet. Hon läser kemi vid universitetet i Lund. Himlen var grå och det blåste en kall vind.
Den här osten kommer från bergen i norr. Fåglarna flyger söderut på hösten. Jag glömde släcka ljuset i korridoren. Vi hoppas att snart ses igen vid ett annat tillfälle.""",
    "fi": """Kissa nukkuu sohvalla ikkunan vieressä. Huomenna aamulla menemme torille ostamaan leipää. Siskoni työskentelee sairaalassa kaupungin ulkopuolella. En tiedä, mihin laitoin auton avaimet.
Eilen illalla söimme erittäin hyvää kalaa. Juna Tampereelle lähtee puoli yhdeksältä. Lapset leikkivät puutarhassa koulun takana. Kun sataa, luen mieluummin kirjaa kotona.
Opettaja selitti läksyn hyvin kärsivällisesti. Isoisäni kertoo aina tarinoita nuoruudestaan. Keittiön ikkuna oli auki koko yön. Haluaisin varata pöydän neljälle hengelle.
Kauppa suljetaan joka päivä seitsemältä illalla. Löysimme pienen hotellin läheltä merta. Hän opiskelee kemiaa Helsingin yliopistossa. Taivas oli harmaa ja puhalsi kylmä tuuli.
Tämä juusto tulee pohjoisen vuorilta. Linnut lentävät syksyllä etelään. Unohdin sammuttaa valon käytävästä. Toivottavasti tapaamme pian uudelleen.""",
    "ro": """Pisica doarme pe canapea lângă fereastră. Mâine dimineață mergem la piață să cumpărăm pâine. Sora mea lucrează într-un spital în afara orașului. Nu știu unde am pus cheile de la mașină.
Aseară am mâncat un pește foarte bun. Trenul spre Cluj pleacă la opt și jumătate. Copiii se joacă în grădina din spatele școlii. Când plouă prefer să citesc o carte acasă.
Profesorul a explicat lecția cu multă răbdare. Bunicul meu povestește mereu întâmplări din tinerețe. Fereastra bucătăriei a rămas deschisă toată noaptea. Aș vrea să rezerv o masă pentru patru persoane.
Magazinul se închide în fiecare zi la ora șapte. Am găsit un hotel mic aproape de mare. Ea studiază chimia la universitatea din Iași. Cerul era cenușiu și bătea un vânt rece.
Brânza aceasta vine din munții din nord. Păsările zboară toamna spre sud. Am uitat să sting lumina de pe hol. Sperăm să ne revedem curând cu altă ocazie.""",
    "hu": """A macska az ablak melletti kanapén alszik. Holnap reggel a piacra megyünk kenyeret venni. A nővérem egy városon kívüli kórházban dolgozik. Nem tudom, hová tettem az autó kulcsait.
Tegnap este nagyon finom halat ettünk. A szegedi vonat fél kilenckor indul. A gyerekek az iskola mögötti kertben játszanak. Ha esik az eső, inkább otthon olvasok egy könyvet.
A tanár nagy türelemmel magyarázta el a leckét. Nagyapám mindig a fiatalságáról mesél történeteket. A konyha ablaka egész éjjel nyitva maradt. Szeretnék asztalt foglalni négy személyre.
A bolt minden nap este hétkor zár. Találtunk egy kis szállodát közel a tengerhez. Kémiát tanul a debreceni egyetemen. Az ég szürke volt, és hideg szél fújt.
Ez a sajt az északi hegyekből származik. A madarak ősszel délre repülnek. Elfelejtettem lekapcsolni a villanyt a folyosón. Reméljük, hogy hamarosan újra találkozunk.""",
}


def sentences() -> list[tuple[str, str]]:
    """(language, sentence) of all."""
    return [(lang, s.strip().rstrip(".") + ".") for lang, text in SENTENCES.items() for s in text.replace("\n", " ").split(". ") if s.strip()]
