"""Word lists, lookup tables and code ranges the results depend on."""

# Characters lost in an earlier export, and the words they belong to.
ENCODING_REPAIRS = [
    ("OBSTRUCCI�N", "OBSTRUCCIÓN"),
    ("CA�DA", "CAÍDA"),
    ("RESPIRACI�N", "RESPIRACIÓN"),
    ("INGESTI�N", "INGESTIÓN"),
    ("INHALACI�N", "INHALACIÓN"),
    ("V�AS", "VÍAS"),
    ("EXPOSICI�N", "EXPOSICIÓN"),
    ("G�STRICOS", "GÁSTRICOS"),
    ("EL�CTRICA", "ELÉCTRICA"),
    ("FR�O", "FRÍO"),
]

# Method text: the first contained phrase gives the label.
METHOD_RULES = [
    ("AHORCAMIENTO", "Ahorcamiento o asfixia"),
    ("ARMAS DE FUEGO", "Armas de fuego"),
    ("Arma de fuego", "Armas de fuego"),
    ("AUTOINFLIGIDA", "Lesiones autoinfligidas"),
    ("FACTORES NO ESPECIFICADOS", "Otros"),
    ("NO ESPECIFICADA DE LA RESPIRACIÓN", "Ahorcamiento o asfixia"),
    ("OBSTRUCCIÓN DE LAS VÍAS RESPIRATORIAS", "Ahorcamiento o asfixia"),
    ("AHOGAMIENTO Y SUMERSI", "Ahogamiento"),
    ("FUEGO", "Fuego"),
    ("CAÍDA", "Caída"),
    ("ENVENENAMIENTO AUTOINFLIGIDO INTENCIONALMENTE", "Envenenamiento autoinfligido intencionalmente"),
    ("ENVENENAMIENTO ACCIDENTAL", "Envenenamiento accidental"),
    ("ENVENENAMIENTO", "Envenenamiento"),
    ("EVENTO NO ESPECIFICADO", "Otros"),
    ("INHALACIÓN DE CONTENIDOS GÁSTRICOS", "Inhalación de contenidos gástricos"),
    ("CORRIENTE ELÉCTRICA", "Corriente eléctrica"),
    ("EXPOSICIÓN AL FRÍO NATURAL", "Frío Natural"),
]
METHOD_EXACT = [("otros", "Otros")]
METHOD_CATEGORIES = [
    "Ingesta de Medicamentos", "Ahorcamiento o asfixia", "Lesiones autoinfligidas", "Armas de fuego", "Caída",
]
METHOD_DEFAULT = "Otros"

# Decision text.
DECISION_RULES = [
    ("RESUELTO", "RESUELTO"),
    ("NO CUMPLE", "NO CUMPLE PROTOCOLO"),
    ("SUICIDIO", "SUICIDIO"),
    ("INTERNAD", "INTERNADO"),
    ("PENDIENTE RESPUESTA", "PENDIENTE RESPUESTA"),
    ("PENDEINTE RESPUESTA", "PENDIENTE RESPUESTA"),
]
DECISION_EXACT = [
    ("PENDIENTE INTERNADO", "INTERNADO"),
    ("SIN RESPUESTA DEFINITIVA", "PENDIENTE RESPUESTA"),
    ("SIN RESPUESTA", "PENDIENTE RESPUESTA"),
]
DECISION_CATEGORIES = ["RESUELTO", "NO CUMPLE PROTOCOLO", "PENDIENTE RESPUESTA", "INTERNADO", "SUICIDIO"]
DECISION_DEFAULT = "OTRA DECISION"

# Follow-up text, after the decision rules.
FOLLOWUP_TYPOS = [("DESCARTDO", "DESCARTADO"), ("DECARTADA", "DESCARTADA")]
FOLLOWUP_RULES = [
    ("DESCARTAD", "DESCARTADA_POR_RASTREADOR"),
    ("SIN COBERTURA", "SIN COBERTURA ASISTENCIAL"),
]
FOLLOWUP_EXACT = [("SEG PARTICULAR", "SEGUIMIENTO PARTICULAR")]
FOLLOWUP_DISCARDED = "DESCARTADA_POR_RASTREADOR"

# Previous-event text.
PREVIOUS_RULES = [("Tratamiento", "Tratamiento")]
PREVIOUS_EMPTY = ["Sin dato", ""]
PREVIOUS_DEFAULT = "NO SE INDICA"
PREVIOUS_YES = "SI"
PREVIOUS_NO = "NO"

# Provider names.
PUBLIC_MARKS = ["ASSE", "POLICIAL", "FUERZAS ARMADAS", "FF.AA", "CLINICAS"]
PUBLIC, PRIVATE = "Pública", "Privada"
PROVIDER_UNKNOWN = "No indicado"
PROVIDER_MISSING_TEXT, PROVIDER_MISSING_LABEL = "NaN", "nan"

# Provider names in the first version of the data.
PUBLIC_NAMES_FIRST = [
    "ASSE - Administración de Servicios de Salud del Estado", "Hospital de Clínicas", "Hospital Militar",
    "Hospital Policial",
]
OTHER_NAMES_FIRST = ["No indicado", "No corresponde"]
PUBLIC_FIRST, PRIVATE_FIRST, OTHER_FIRST = "Publica", "Privada", "Otro"
PUBLIC_MARK_FIRST = "ASSE"

# Cause-code groups: letter, first number, last number.
CODES_INTENTIONAL = [("X", 60, 84)]
CODES_OTHER_EXTERNAL = [("V", 0, 99), ("W", 0, 99), ("X", 0, 59), ("X", 85, 99), ("Y", 40, 87)]
CODE_LABELS = {
    "X60": "Envenenamiento analgésicos",
    "X61": "Envenenamiento sedantes",
    "X62": "Envenenamiento narcóticos",
    "X63": "Envenenamiento otras drogas especificadas",
    "X64": "Envenenamiento otras drogas no especificadas",
    "X65": "Envenenamiento alcohol",
    "X66": "Envenenamiento hidrocarburos",
    "X67": "Envenenamiento otros gases",
    "X68": "Envenenamiento plaguicidas",
    "X69": "Envenenamiento no específicado",
    "X70": "Ahorcamiento",
    "X71": "Ahogamiento",
    "X72": "Disparo arma corta",
    "X73": "Disparo arma larga",
    "X74": "Disparo otras armas",
    "X75": "Material Explosivo",
    "X76": "Incendio",
    "X77": "Vapores",
    "X78": "Objeto cortante",
    "X79": "Objeto romo",
    "X80": "Salto",
    "X81": "Interponerse a vehículo",
    "X82": "Colisionar vehículo",
    "X83": "Lesión autoinfligida especificada",
    "X84": "Lesión autoinfligida no especificada",
    "X85": "Drogas",
    "X86": "Sustancia corrosiva",
    "X87": "Plaguicida",
}
EXTERNAL_MOTIVE = "SUICIDIO"
EXTERNAL_MOTIVE_FIRST = "Suicidio"

# Population by region, for rates.
POPULATION = {
    "Montevideo": 1384210,
    "Artigas": 73300,
    "Canelones": 625698,
    "Cerro Largo": 89663,
    "Colonia": 132517,
    "Durazno": 58945,
    "Flores": 26460,
    "Florida": 69326,
    "Lavalleja": 58276,
    "Maldonado": 202187,
    "Paysandú": 120529,
    "Río Negro": 58897,
    "Rivera": 109652,
    "Rocha": 74470,
    "Salto": 134920,
    "San José": 120935,
    "Soriano": 83373,
    "Tacuarembó": 92737,
    "Treinta y Tres": 50460,
}

# Vaccination descriptions and the columns their last dose goes to.
DOSE_PATTERNS = {"ANTIPOLIOMELITICA": "ANTIPOLIOMELÍTICA", "COVID 19": "COVID 19"}

# Prompts of the document jobs.
PROMPT_PLAIN = """
Eres un asistente experto. Por favor responde en español y sigue estas reglas:
- Sé claro y conciso
- Mantén un tono formal pero cercano
- Siempre incluye ejemplos si es necesario
- No inventes información

Contexto:
{context}

Pregunta:
{question}
"""
PROMPT_DOCUMENT = """
Eres un asistente experto. Por favor responde en español y sigue estas reglas:
- Sé claro y conciso
- Mantén un tono formal pero cercano
- Siempre incluye ejemplos si es necesario
- No inventes información

Contexto del documento: {context}

Pregunta del usuario: {question}

Respuesta:
"""
PROMPT_WITH_HISTORY = """Eres un asistente experto en salud mental de la OMS.
Usa el contexto recuperado para contestar la pregunta de manera clara, empática y precisa.
Si no sabes la respuesta, indica que no la encuentras en los documentos. Responde siempre en español y se breve.

Contexto:
{context}

Historial de conversación:
{chat_history}

Pregunta:
{question}

Respuesta:"""
SOURCE_UNKNOWN = "desconocido"
