"""Fixed values of one deployment: the plot market around Łomża.

Nothing in the library depends on this module; it only fills in arguments.
"""

from __future__ import annotations

# Gazetteer as "name; latitude; longitude", in matching order. Names come in the
# spelling of the source data, including one that occurs twice and one in mixed case;
# `sources.dimensions.parse_gazetteer` settles both.
GAZETTEER_TEXT = """
ROMOTY; 53.80214400879721; 22.650666695341755
ELŻBIECIN; 53.1672; 22.1231
ZAMBRÓW; 52.9856; 22.2428
STARE ZAKRZEWO; 53.0042; 22.2983
PUPKI; 53.2258; 21.8497
WYGODA; 53.1022; 22.1481
STARE MODZELE; 53.1114; 22.3164
NOWOGRÓD; 53.2264; 21.8806
CZERWONE; 53.4336; 21.9044
JANKI STARE; 52.9419; 22.4278
GRĄDY; 53.1158; 22.1158
CZACHY; 53.0453; 22.3456
GROCHY; 52.9461; 22.3614
DROZDOWO; 53.1492; 22.1644
DĄBEK; 53.0414; 21.4647
OSTROŁĘKA; 53.0842; 21.5731
SIEMIEŃ NADRZECZNY; 53.1978; 22.1853
SZLASY; 53.0614; 22.0647
GRZYMAŁY SZCZEPANKOWSKIE; 53.1436; 21.9892
CZERWIN; 52.9239; 21.6442
FILOCHY; 52.9481; 21.7258
KISIOŁKI; 53.1667; 22.3333
BALIKI; 53.2847; 21.8594
JANOWO; 53.4864; 21.9069
SZUMOWO; 52.9153; 22.0736
STARA ŁOMŻA PRZY SZOSIE; 53.1603; 22.0944
NOWY CYDZYN; 53.2753; 22.1764
STARE BOŻEJEWO; 53.2383; 22.3486
DŁUGI KĄT; 53.3308; 21.7375
ZAWADY; 53.1539; 22.6653
MIASTKOWO; 53.1489; 21.8211
KSIĘŻOPOLE; 52.3306; 22.2547
JEDWABNE; 53.2861; 22.3019
NOWE KUPISKI; 53.1975; 21.9844
TRUSZKI; 53.3236; 22.1158
ŚWIDRY; 53.1561; 21.9056
SASINY; 52.6186; 22.9511
WYSOKIE MAŁE; 53.2681; 22.1156
WIZNA; 53.1931; 22.3831
RUTKI; 53.1000; 22.4167
SIEMNOCHA; 53.2458; 22.0833
NAGÓRKI; 53.1581; 22.3333
CZAPLICE; 53.1114; 22.1258
MROCZKI; 52.9983; 22.3364
JURZEC WŁOŚCIAŃSKI; 53.3000; 22.2167
KOLNO; 53.4131; 21.9322
STARE RATOWO; 53.0114; 21.8456
KRUSZA; 53.0781; 21.5031
GRODZISK DUŻY; 52.4833; 22.7500
OJCEWO; 53.3364; 22.2542
BACZE SUCHE; 53.0564; 22.1647
GOSIE MAŁE; 53.0244; 22.4214
JABŁONKA; 53.5358; 21.5061
POPIOŁKI; 53.3642; 21.8597
DRWĘCZ; 53.0647; 21.6642
PODGÓRZE; 53.1203; 22.1236
RZEKUŃ; 53.0561; 21.6167
STARA ŁOMŻA NAD RZEKĄ; 53.1656; 22.1128
SZCZEPANKOWO; 53.1167; 21.9833
JARNUTY; 53.1167; 21.6833
TUROŚL; 53.3853; 21.7258
STARE KUPISKI; 53.1972; 21.9964
KUPISKI STARE; 53.1972; 21.9964
DŁUGOBÓRZ PIERWSZY; 52.9667; 22.2167
WIKTORZYN; 52.8833; 21.7500
KACZYNEK; 53.0114; 21.6831
RYBAKI; 53.1842; 22.3164
SAMBORY; 53.2258; 22.3853
LELIS; 53.1592; 21.5644
RUDKA; 52.7333; 22.7333
KRAJEWO; 52.9833; 22.3333
WYŁUDZIN; 53.2458; 21.7258
LASKI SZLACHECKIE; 52.9414; 21.4647
RYDZEWO; 53.3086; 22.0647
SULĘCIN SZLACHECKI; 52.8464; 21.9167
PIĄTNICA PODUCHOWNA; 53.1894; 22.0919
BARTKI; 53.3414; 21.5258
KORYTKI LEŚNE; 53.1333; 21.9500
OSTROŻNE; 52.9833; 22.1167
PROSIENICA; 52.9167; 21.9500
STARY CYDZYN; 53.2753; 22.1856
JURKI; 53.3983; 22.1114
DOBRY LAS; 53.3167; 21.8333
LACHOWO; 53.4667; 22.0167
GOSTERY; 53.0333; 21.8667
STARE KRAJEWO; 52.9833; 22.3500
STARY LUBOTYŃ; 52.9167; 21.8833
BORKOWO; 53.2986; 21.9142
MOCARZE; 53.2758; 22.4258
TABĘDZ; 53.0333; 22.1667
JEZIORKO; 53.2281; 22.1456
ŁAWY; 53.0667; 21.6167
ŁOCHTYNOWO; 53.1667; 22.0333
WOLA ZAMBROWSKA; 52.9667; 22.2500
LASKOWIEC; 53.0833; 21.5333
GIEŁCZYN; 53.1114; 22.0542
PORYTE; 53.3258; 22.0831
ŁOMŻA; 53.1781; 22.0592
TROSZYN; 53.0333; 21.7333
MOTYKA; 53.1667; 21.8833
PIANKI; 53.2167; 22.0167
KISIELNICA; 53.2286; 22.0542
KONOPKI; 53.0667; 22.3167
BURZYN; 53.2758; 22.4647
KOSAKI; 53.1667; 22.2833
KĄTY; 53.3167; 22.1667
RATOWO; 53.0167; 21.8333
PNIEWO; 53.1167; 22.0833
KOŁAKI KOŚCIELNE; 53.0167; 22.3667
BUDY CZARNOCKIE; 53.2167; 22.1500
KOWNATY; 53.2667; 22.2167
OSETNO; 53.6833; 19.8667
MIKOŁAJKI; 53.8014; 21.5714
KONARZYCE; 53.1333; 22.0500
JEDNACZEWO; 53.2081; 21.9542
PRZYTUŁY; 53.3667; 22.3167
GOŁASZE; 52.9833; 22.5000
KRZEWO; 53.1500; 22.3667
STARY GROMADZYN; 53.4000; 21.9167
KARWOWO; 53.2667; 22.3833
OBRYTKI; 53.3687798; 22.2742335
ZABAWKA; 53.1995772; 22.1571153
SIEBURCZYN; 53.2414279; 22.4342496
SZÓSTAKI; 53.2833309; 22.4569495
GÓRKI-SYPNIEWO; 53.273853; 22.1353291
ŚNIADOWO; 53.0386233; 21.9902764
SIESTRZANKI; 53.306823; 22.4139482
BUDY MIKOłAJKA; 53.255353; 22.1711752
MODZELE SKUDOSZE; 53.0550814; 22.1775928
PIĄTNICA WŁOŚCIAŃSKA; 53.1859359; 22.1050388
RZADKOWO; 53.2219677; 22.143627
PIĄTNICA; 53.21542775; 22.177244553669112
ZOSIN; 53.141755; 22.1116481
MORGOWNIKI; 53.2275; 21.8903
JANÓW; 53.1558; 22.1353
JĘCZNIKI; 53.5358; 20.9414
WYK; 53.2758; 21.9058
PTAKI; 53.3058; 21.8481
ZBÓJNA; 53.2358; 21.8153
BUDNE; 53.3342; 22.4286
NOWY KRZEW; 53.1158; 22.2542
KOZIOŁ; 53.4258; 21.8986
MIASTKOWO; 53.1508; 21.8386
DĘBOWO; 53.6058; 22.9253
BUDY KRANOCKIE; 53.1958; 22.1486
STARA ŁOMŻA; 53.1658; 22.0986
STAREJ ŁOMŻY; 53.1658; 22.0986
SIEMIĘ NADRZECZNE; 53.1858; 22.0253
WYRZYKI; 53.1058; 22.1553
ROGIENICE WIELKIE; 53.1616; 22.044
KOBYLIN; 53.293171789627955; 22.14513394107225
DROŻĘCIN; 53.257559093803906; 22.023860100319418
CHOJNY MŁODE; 53.15760997932995; 21.932303477720296
SIERZPUTY MŁODE; 53.16337885578543; 21.98731343276766
"""

# Misspelt or useless place names. "BRAK" stands for "no place given".
PLACE_CORRECTIONS = {
    "GEŁCZYN": "GIEŁCZYN",
    "GlŁCZYN": "GIEŁCZYN",
    "MIASTKÓW": "MIASTKOWO",
    "NOWODROD": "NOWOGRÓD",
    "BUDACH CZARNOCKI": "BUDY CZARNOCKIE",
    "KARWIEŃSKIE BŁOTA II": "BRAK",
    "KRZEW": "KRZEWO",
    "SIERZPUTY": "SIERZPUTY MŁODE",
    "WALKOWA": "BRAK",
    "LAS": "BRAK",
    "BRAK": "BRAK",
    "JEDNOCZEŚWI": "BRAK",
}
NO_PLACE = "BRAK"
DEFAULT_PLACE = "ŁOMŻA"

# Spellings of one village, and its accepted name.
VILLAGE_VARIANTS = ["STARA ŁOMŻA NAD RZEKĄ", "STARA ŁOMŻA PRZY SZOSIE", "STAREJ ŁOMŻY"]
VILLAGE_NAME = "STARA ŁOMŻA"

# Weekday names, Monday first.
WEEKDAYS = ["Poniedziałek", "Wtorek", "Środa", "Czwartek", "Piątek", "Sobota", "Niedziela"]

# Published names of the sources.
SOURCE_NAMES = {
    "offers_polnoc": "Website A",
    "analyzed_offers": "Website B",
    "offers_tytan": "Website C",
    "offers_gralczyk": "Website D",
    "offers": "Website E",
}
OTHER_SOURCE = "Other"

# Centre of the main city (latitude, longitude).
CENTRE = (53.1781, 22.0592)

# Upper edges of the size segments in m2 (right-closed) and their labels.
SIZE_BREAKS = [700.0, 1000.0, 1500.0, 5000.0, 10000.0]
SIZE_LABELS = [
    "Tiny/Sub-standard",
    "Small Plot",
    "Medium Plot",
    "Large Plot",
    "Investment/Small Farm",
    "Hectares/Agriculture",
]

# Areas known to be wrong at the source.
AREA_OVERRIDES = {"dzialka-jedwabne-lomzynska": 10200.0}
