"""Words, stems and patterns that texts are read by, plainly and in their order. They must be what they are for
the same readings; how they are used is in the modules that import them."""

from __future__ import annotations

#: Characters that are left out of names' keys.
APOSTROPHES = "'‘’ʼ`´"
#: A word of a text, apostrophes and hyphens within it included.
WORD = r"[\p{L}\p{Nd}]+(?:['‘’ʼ`´-][\p{L}\p{Nd}]+)*"
#: Compass points and bearings, which are no place unless spelled as a place's own name.
COMPASS = r"^(?:(?:північно|південно)-)?(?:північ|півноч|північн|південь|півдн|півден|південн|захід|заход|західн|схід|сход|східн)[а-яіїєґ]*$|^(?:пн|пд|сх|зх)$"
#: Ordinary words that are also forms of short names.
NEVER_A_PLACE = ("мені", "мене", "мною", "мену", "меною", "сума", "суму", "сумі", "сумою", "сумам", "сумах", "чабан", "чабанам", "чабанах", "троє", "троєю")
#: Nouns after which an adjective is the name of a region or district, and what may stand between such adjectives.
REGION_HEADS = ("область", "області", "областю", "областей", "областям", "областями", "областях", "обл")
DISTRICT_HEADS = ("район", "району", "районі", "районом", "районе", "райони", "районів", "районам", "районами", "районах", "р-н", "р-ні", "р-ну", "р-нi", "рн")
CONNECTORS = ("та", "і", "й", "та-й", "а", "або")
ADMIN_NAME = r"^(.+?)\s+(область|район)$"

#: Signs of preparations and launches: (name, pattern, classes, scope). Those of scope launch are aimed at the country wherever
#: they are; ambient ones are activity elsewhere.
STRATEGIC: list[tuple[str, str, tuple[str, ...], str]] = [
    ("зліт стратегічної авіації", r"(зліт|підня(?:то|лися)|у повітрі).{0,45}(ту[-– ]?(95|160)|стратегічн[а-яіїєґ]* авіаці)", ("cruise_missile",), "launch"),
    ("активність МіГ-31К", r"(міг[-– ]?31к|mig[-– ]?31k|носі[йя].{0,20}кинджал)(?![^.!?\n]{0,40}(?:посадк|приземл|призем))", ("ballistic_missile",), "launch"),
    ("посадка МіГ-31К", r"((?:міг[-– ]?31к|mig[-– ]?31k)[^.!?\n]{0,40}(?:посадк|приземл|призем)|(?:посадк|приземл|призем)[а-яіїєґ]*[^.!?\n]{0,40}(?:міг[-– ]?31к|mig[-– ]?31k))", ("ballistic_missile",), "ambient"),
    ("активність пускових установок", r"(с[-– ]?300|с[-– ]?400|іскандер).{0,45}(активн|робот|переміщ|готовн|пуск)", ("ballistic_missile",), "launch"),
    ("загроза застосування С-300/С-400", r"(?:загроз[а-яіїєґ]*\s+застосуванн[а-яіїєґ]*|застосуванн[а-яіїєґ]*|удар[а-яіїєґ]*|обстріл[а-яіїєґ]*|пуск[а-яіїєґ]*)[^.!?\n]{0,30}(?<!\p{L})с[-– ]?[34]00", ("ballistic_missile",), "launch"),
    ("активність ракетоносіїв у морі", r"(ракетоносі[йї]|носі[йї].{0,25}калібр|корабл[а-яіїєґ]*.{0,25}калібр)", ("cruise_missile",), "launch"),
    ("пуски з морської акваторії", r"((?:пуск|запуск|старт)[а-яіїєґ]*[^.!?\n]{0,40}(?:акватор[а-яіїєґ]*|чорного\s+моря|чорному\s+морі|азовського\s+моря|азовському\s+морі)|(?:акватор[а-яіїєґ]*|чорного\s+моря|чорному\s+морі|азовського\s+моря|азовському\s+морі)[^.!?\n]{0,40}(?:пуск|запуск|старт)[а-яіїєґ]*)", ("cruise_missile",), "launch"),
    ("ознаки підготовки БпЛА", r"(пуск|запуск|старт|груп[а-яіїєґ]*).{0,35}(шахед|бпла|безпілотник)", ("uav",), "launch"),
    ("робота ворожої ППО", r"(робот[а-яіїєґ]*|активн[а-яіїєґ]*).{0,25}(ворож[а-яіїєґ]* ппо|ппо рф)", ("ballistic_missile", "cruise_missile"), "ambient"),
]
#: A direction that is stated, and what makes an ordinary noun a report.
STATED_DIRECTION = r"((?<!\p{L})курс(?:ом)?\s+(?:на|до|у|в)(?!\p{L})|(?<!\p{L})курс(?:ом)?\s+(?:північн|південн|східн|західн)|[ув]\s+напрямку|(?<!\p{L})[ув]\s+бік|прямує\s+(?:до|на|у|в)(?!\p{L})|руха(?:ється|ються)\s+(?:до|на)(?!\p{L})|трима(?:є|ють|ємо)\s+курс)"
REPORT_SHAPE = r"((?<!\p{L})курс|напрямк|(?<!\p{L})[ув]\s+бік|прямує|руха(?:ється|ються)|(?<!\p{L})лет(?:ить|ять|іти)|(?<!\p{L})йд(?:е|уть)(?!\p{L})|заход(?:ить|ять)|наближ|(?<!\p{L})увага(?!\p{L})|загроз|небезпек|укритт|(?<!\p{L})тривог|(?<!\p{L})(?:за)?пуск|атаку|удар|збито|\d+\s*х?\s*(?:дрон|ракет|бомб))"
#: Signs that count beside a place of the country alone: (name, pattern, classes, what the text must also have or None).
CONTEXT: list[tuple[str, str, tuple[str, ...], str | None]] = [
    ("розвідувальна активність БпЛА", r"(дорозвідк[а-яіїєґ]*|(?<!\p{L})розвідник[а-яіїєґ]*|розвідувальн[а-яіїєґ]*\s+(бпла|дрон[а-яіїєґ]*|безпілотник[а-яіїєґ]*))", ("uav",), None),
    ("морські безпілотники", r"(морськ[а-яіїєґ]*\s+(?:безпілотник|дрон)[а-яіїєґ]*|безекіпажн[а-яіїєґ]*\s+катер[а-яіїєґ]*|надводн[а-яіїєґ]*\s+(?:безпілотник|дрон)[а-яіїєґ]*)", ("uav",), None),
    ("повторний захід", r"(?<!\p{L})(?:повторн[а-яіїєґ]*|знову)\s+(?:[^.!?\n]{0,20}?)(?:курс(?:ом)?\s+на|у\s+напрямку|в\s+напрямку|заход[а-яіїєґ]*|захід)", (), None),
    ("рух цілі за напрямком", r"(?:→|➡|⮕|➤|-->|->)\s*\p{L}", (), None),
    ("повідомлений напрямок без названого типу", STATED_DIRECTION, (), None),
    ("дрони без уточнення типу", r"(?<!\p{L})дрон(?:а|и|у|ом|ів|ам|ах|ами|і)?(?!\p{L})", ("uav",), REPORT_SHAPE),
    ("ракета без уточнення типу", r"(?<!\p{L})ракет(?:а|и|у|ою|ам|ах|ами|і)?(?!\p{L})", (), REPORT_SHAPE),
    ("авіабомба без уточнення типу", r"(?<!\p{L})бомб(?:а|и|у|ою|ам|ах|ами|і)?(?!\p{L})", (), REPORT_SHAPE),
]
#: Stems of places beyond the border.
FOREIGN_STEMS = (
    "брянськ", "брянск", "брянщин", "курськ", "курск", "курщин", "бєлгород", "белгород", "білгород", "москв", "ростов", "воронеж",
    "таганрог", "новоросійськ", "рязан", "саратов", "енгельс", "энгельс", "оленья", "оленєгорськ", "шайковк", "міллеров", "морозовськ",
    "приморсько-ахтарськ", "єйськ", "саваслейк", "ахтубінськ", "краснодар", "анапа", "сочі", "тамань", "кубан",
    "мозир", "гомел", "мінськ", "барановичі", "лунінец", "мачулищ", "бобруйськ", "речиц", "калинковичі",
)
#: Jokes, promotion and fund-raising; what makes a report of such a text all the same; and warnings to the whole country.
COMMENTARY = r"((?<!\p{L})мем(?:и|ів|ам|ах|ами|ас[а-яіїєґ]*|чик[а-яіїєґ]*)?(?!\p{L})|гумор|жарт[а-яіїєґ]*|анекдот|сатир[а-яіїєґ]*|рофл|прикол|тролін[а-яіїєґ]*|😂|🤣|😹|підписуйт|підписуйся|реклам[а-яіїєґ]*|монобанк|mono\.bank|send\.monobank|реквізит[а-яіїєґ]*|донат[а-яіїєґ]*|збір на)"
OPERATIONAL = r"([ув] напрямку|курс(?:ом)? на|прямує до|руха(?:ється|ються) до|(?<!\p{L})[ув] бік|загроза застосування|(?<!\p{L})(?:за)?пуск|(?<!\p{L})зліт|\d+\s*хв)"
NATIONAL = r"(по всій (?:території )?україн[аиі]|вся територія україни|загроза застосування|масован(?:ий|а) (?:удар|атака|обстріл))"
