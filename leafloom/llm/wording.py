"""Function words, language names and refusal wording in the languages of the corpus."""

STOPWORDS = {
    "en": "a an if when while also more most other same only first second within without along across because so very can may must would should the of and to in for with by from at as on an is are was were this that these those it its be has have not or but which after before during near under over into than then there they you your all any each every most some such no give me find list what please return extract answer page text only nothing else",
    "de": "der die das den dem des und mit von für auf aus im zum zur bei ist sind war nicht oder aber nach vor während ein eine einen einem einer eines wie es sich als auch an am dass wird werden nur sonst nichts ich brauche bitte nenne suche gib zurück jeden alle über unter neben ohne seit bis",
    "fr": "nous vous ils elle elles lorsque ainsi même très aussi où dont leur leurs entre chez quelques plusieurs pendant celui celle cela ici le la les l des du de et un une dans pour avec par sur au aux est sont pas ou mais qui que ce cette ces après avant pendant sous près sans depuis à d en son sa ses tous toutes chaque rien autre je veux donne trouve extrais merci renvoyer cités texte selon toute",
    "es": "lo nos ya muy todo toda cuando también ese esa eso hacia partir pesar otro otra otros unos unas entre donde mientras ni si quien el la los las de del y un una en para con por sobre al es son no o pero que este esta estos después antes durante bajo cerca sin desde hasta cada todos todas nada más quiero busca indica extrae devuelve aparecen texto su sus según junto hay",
    "pt": "pelos pelas isso esse essa nesse desse nessa dessa já muito quando também outro outra entre onde enquanto nem se quem uns umas ainda lado o a os as de do da dos das e um uma em no na nos nas num numa para com por sobre ao aos é são não ou mas que este esta depois antes durante sob perto sem desde até cada todos todas nada mais quero encontre indique extraia devolva aparecem texto seu sua segundo pelo pela muita há",
    "it": "anche come nei negli degli agli dei quando quello quella altri altra tra dove mentre né se chi uno alcuni pochi fino parte lato il lo la i gli le di del della dei delle dello e un una in nel nella nelle per con da dal dalla su sul sulla al alla è sono non o ma che questo questa dopo prima durante sotto vicino senza ogni tutti tutte voglio trova indica estrai restituisci citati testo altro l dell nient più secondo",
}

#: Letters that one of the languages alone has.
LETTERS = {"pt": "ãõ", "es": "ñ¿¡", "de": "äöüß", "fr": "œêîûè", "it": "ìò"}

#: Names of the languages in each of them, folded to lower case.
LANGUAGE_NAMES = {
    "en": "english englisch anglais inglés inglês inglese",
    "de": "german deutsch allemand alemán alemão tedesco",
    "fr": "french französisch français francés francês francese",
    "es": "spanish spanisch espagnol español espanhol spagnolo",
    "pt": "portuguese portugiesisch portugais portugués português portoghese",
    "it": "italian italienisch italien italiano",
}

ANSWER_IN = r"\b(?:answer|respond|reply|write|antworte|antworten sie|beantworte|répond[sez]*|responde|responda|contesta|conteste|rispondi|risponda|scrivi)\s+(?:in|auf|en|em|into)\s+(\w+)"

#: Function words of further languages; those that a language above has too don't count.
MORE_STOPWORDS = {
    "nl": "het een niet zijn voor maar ook naar wordt worden deze dit hij zij wij jullie heeft hebben bij uit nog wel dan omdat waar welke geen alleen werd waren kunnen moet tussen tegen onder zonder door",
    "sv": "och att det som inte är på av för med till har från ett eller men vid också efter mellan utan denna detta dessa blir kan ska måste vara varit när där hur alla någon",
    "da": "og at det som ikke er på af til har fra et eller men ved også efter mellem uden denne dette disse bliver skal være været når hvor alle nogen jeg",
    "no": "og det som ikke på av til har fra et eller men ved også etter mellom uten denne dette disse blir skal være vært når hvor alle noen jeg",
    "pl": "się nie jest na że jak przez dla jego tylko oraz może który która które był była było być są przy pod nad bez już więc kiedy gdzie",
    "cs": "se je že jako pro jeho nebo ale který která které byl byla bylo být jsou při pod bez již když kde také pouze",
    "ro": "și este nu pentru care din mai sunt sau dar acest această când unde după prin fără între numai foarte",
    "tr": "bir ve bu için ile olarak daha çok gibi kadar sonra değil olan olduğu ancak hem veya",
    "fi": "ja on ei että se oli mutta kun myös joka ovat tämä vain kuin sekä ole niin",
    "hu": "és az egy nem hogy ez volt csak mint is már még vagy ha van ezek között után",
    "id": "yang dan di untuk dengan tidak ini itu dari pada adalah akan oleh juga dalam telah bisa karena",
    "vi": "và của là không có cho được trong một những các với này khi đã người",
}

#: First and last code point of the letters of a script and the language they vote for.
SCRIPTS = (
    (0x370, 0x3FF, "el"), (0x400, 0x52F, "ru"), (0x590, 0x5FF, "he"), (0x600, 0x6FF, "ar"), (0x900, 0x97F, "hi"), (0xE00, 0xE7F, "th"),
    (0x3040, 0x30FF, "ja"), (0x4E00, 0x9FFF, "zh"), (0xAC00, 0xD7AF, "ko"),
)

# Kinds of words that make up a refusal, in the languages of the corpus; a blank at an end stands for the end of a word.
REFUSAL_KINDS = {
    "self": """
 i | i'm | i am | i've | i'd | i'll | me | my | myself | we | assistant | ai | language model | chatbot
 ich | mir | mich | mein| wir | assistent| ki |sprachmodell
 je | j'| me | m'| mes | mon | ma | nous | assistant| moi | il m
 puedo | tengo | debo | podemos | me | mis | mi | siento | nosotros | asistente | soy | estoy | yo | puedo
 posso | consigo | tenho | devo | me | minha| meu| sinto | nós | assistente | sou | estou | eu | podemos |-me
 riesco | devo | mi | mie | mio | mia | noi | possiamo | sono | io
""",
    "unable": """
 prefer not | prefer not to | feel able | cannot | can not | can't | cant | could not | couldn't | won't | will not | would not | wouldn't | unable | not able | not allowed | not permitted | not comfortable | not authori| not in a position | not going to | must not | may not | not possible | impossible | not something i | not willing | no way | refrain | wouldn't be right | rather not | never | incapable
 möchte lieber nicht | kann | könnte| darf | dürfen | nicht möglich | unmöglich | außerstande | nicht in der lage | nicht befugt | nicht erlaubt | nicht gestattet | werde | möchte
 préfère ne pas | préférerais ne pas | peux pas | puis pas | peux | pas en mesure | impossible | pas autorisé| pouvons | saurais | capable de | pas possible | pas à même | veux pas | voudrais pas
 prefiero no | preferiría no | no puedo | no podemos | no podré | no me es posible | imposible | no estoy autoriz| no soy capaz | no es posible | no estoy en condiciones | no debo | no voy a | no quiero | incapaz
 prefiro não | preferia não | não posso | não podemos | não consigo | não poderei | não me é | impossível | não estou autoriz| não sou capaz | não é possível | não devo | não vou | incapaz | não estou em condições
 preferisco non | preferirei non | non posso | non possiamo | non riesco | non potrò | non sono in grado | impossibile | non mi è | non sono autorizz| non è possibile | non devo | non sono capace | non intendo | incapace
""",
    "not": " not |n't | no | cannot | unable | impossible | never | nicht | kein| nichts | unmöglich | außerstande | ne | n'| pas | aucun| impossible | ni | imposible | não | nenhum| impossível | non | nessun| impossibile ",
    "decline": """
 decline| refus| reject the | turn this down | turn that down | turn down | unanswered | leave this | leave that | leave it | abstain | pass on this | have to pass | opt out | withhold | say no
 ablehn| verweiger| lehne | weigere | offen lassen | unbeantwortet | absehen | zurückweis| verzichte
 refuser | refuse | refusons | décliner | décline | sans réponse | abstenir | abstiens | renonce
 rechazar | rechazo | declinar | declino | sin respuesta | abstener| negarme | me niego | sin contestar
 recusar | recuso| declinar | sem resposta | abster| me nego | nego-me
 rifiutar| rifiuto | declin| senza risposta | astener| astengo | mi rifiuto
""",
    "rule": """
 guideline| policy | policies | rules | principles | terms of | instructions | programming | safety | ethic| restrictions | regulations
 richtlinie| regeln | vorgaben | vorschriften | grundsätze | bestimmungen | nutzungsbedingungen | datenschutzgründe
 règles | règlement| directives | consignes | principes | politique | conditions d | éthique
 directrices | normas | reglas | políticas | política | principios | instrucciones
 regras | diretrizes | normas | políticas | política | princípios | instruções
 regole | linee guida | politiche | norme | principi | istruzioni
""",
    "forbid": """
 against | violat| prevent| keep me from | keeps me from | stop me from | stops me from | prohibit| forbid| not allow| n't allow| not permit| n't permit| not let | n't let | outside of what | outside what | beyond what | outside my | beyond my | bars me | breach | conflict with | conflicts with | restricted from | off limits
 gegen | untersag| verbiet| verbot| nicht zu | erlaub| gestatte| verstöß| verstoß| widersprich| hinder| außerhalb
interdi|empêch| contre | contraire | permet pas | permettent pas | autorise pas | autorisent pas | en dehors | enfrein| viole
 impid| prohib| prohíb| contra | no me permit| no permit| fuera de | infring| viola
 imped| proíb| proib| contra | não me permit| não permit| fora d| infring| viola
 impedi| vieta| contro | non mi permett| non permett| non mi consent| non consent| al di fuori | viola
""",
    "task": """
 help| assist| answer| respond| reply | provid| extract| give | given | share | comply | fulfil| complet| process | do that | do this | do so | request | task | question | disclose | reveal | generate | create | support | supply | proceed | hand out | hand over | information | details | data | material | comfortable
 helfen | hilfe | behilflich | antwort| beantwort| geben | weitergeben | herausgeben | extrahier| entnehmen | anfrage | aufgabe | frage | angaben | daten | auskunft | ausführen | erfüllen | bearbeiten | verarbeiten | nachkommen | auslesen | mitteilen | unterstütz| machen | tun
 aider | aide | répondre | réponse | fournir | donner | extraire | demande | tâche | question | divulguer | transmettre | traiter | informations | données | faire | accomplir | effectuer | satisfaire | communiquer | service | cela
 ayudar| ayuda | responder | contestar | facilitar | proporcionar | dar | extraer | petición | solicitud | tarea | pregunta | revelar | procesar | completar | datos | información | hacer | cumplir | compartir | atender | eso | esto
 ajudar | ajuda | responder | fornecer | dar | extrair | pedido | solicitação | tarefa | pergunta | revelar | processar | concluir | dados | informaç| fazer | cumprir | partilhar | compartilhar | atender | isso | isto
 aiutar| aiuto | rispondere | fornire | dare | estrarre | richiesta | compito | domanda | rivelare | elaborare | completare | svolgere | dati | informazioni | fare | soddisfare | condividere | farlo | questo
""",
    "sorry": """
 sorry | apolog| regret | afraid | unfortunately
 leid | leider | bedaure| bedauer| entschuldig| verzeih
 désolé| malheureusement | regrette | navré| excus| pardon
 siento | lamento | lamentablemente | disculp| desafortunadamente | perdón
 sinto muito | lamento | desculp| infelizmente | perdão
 dispiace | spiacente | purtroppo | scus| rammaric
""",
    "withheld": """
 no values | no details | no data | no information | no answer | nothing will be | not be given | not be provided | not be shared | not be disclosed
 keine werte | keine angaben | keine daten | keine auskunft | keine antwort
 aucune valeur | aucune donnée | aucune information | aucune réponse
 no se dar| ningún dato | ningún valor | no se facilit| no se proporcion
 não serão | nenhum dado | nenhum valor | não se forne
 nessun valore | nessun dato | non verranno | non saranno | nessuna informazione
""",
    "private": " private | personal | confidential | sensitive | privat| persönlich| vertraulich| personnel| confidentiel| sensible| privado| personal| confidencia| pessoa| privad| personali | riservat| privati | sensibili ",
}
