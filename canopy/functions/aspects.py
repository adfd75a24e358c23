"""The words by which free-text aspects of music name classes. Fixed values, patterns of whole words in the order in which they are tried."""

from __future__ import annotations

INSTRUMENT = [
    ("acoustic guitar", ["acoustic guitars?", "acoustic rhythm guitar", "rhythmic acoustic guitar", "classical guitar", "nylon string guitar", "spanish guitar"]),
    ("electric guitar", ["electric guitars?", "e-guitars?", "distorted guitar", "distortion guitar", "guitar solo", "amplified guitar", "guitar lead", "lead guitar", "electric guitar melody", "distorted electric guitar", "overdriven guitar"]),
    ("bass guitar", ["bass guitar", "e-bass", "bass line", "bassline", "groovy bass", "upright bass", "double bass", "smooth bass", "strong bass line", "percussive bass line", "bass lines", "bass(?! drum)"]),
    ("violin", ["violins?", "fiddle"]),
    ("cello", ["cellos?"]),
    ("harp", ["harp"]),
    ("piano", ["piano", "acoustic piano", "grand piano", "electric piano", "rhodes"]),
    ("organ", ["organ", "hammond"]),
    ("synthesizer", ["synth", "synths", "synthesizer", "synthesiser", "synth pad", "synth lead", "synth bass", "synthesiser arrangements?", "synth sounds"]),
    ("flute", ["flutes?"]),
    ("clarinet", ["clarinets?"]),
    ("saxophone", ["saxophones?", "sax"]),
    ("trumpet", ["trumpets?"]),
    ("trombone", ["trombones?"]),
    ("drum kit", ["drums", "acoustic drums", "electronic drums", "digital drums", "drum kit", "drumming", "punchy kick", "punchy snare", "kick", "snare", "hi hats?", "hi-hats?", "drum machine", "steady drumming"]),
    ("hand drums", ["tabla", "congas?", "bongos?", "djembe", "hand drums?", "darbuka", "cajon"]),
    ("cymbals", ["cymbals?", "shimmering cymbals"]),
    ("bells", ["bells", "chimes", "glockenspiel", "xylophone", "marimba", "vibraphone"]),
    ("accordion", ["accordion"]),
    ("harmonica", ["harmonica"]),
    ("banjo", ["banjo"]),
    ("orchestral strings", ["strings", "string section", "orchestra", "orchestral", "string ensemble", "sustained strings"]),
    ("other plucked or folk instrument", ["sitar", "mandolin", "ukulele", "oud", "koto", "guzheng", "bouzouki", "lute", "zither", "balalaika", "shamisen", "erhu"]),
]
MOOD = [
    ("energetic", ["energetic", "upbeat", "exciting", "spirited", "enthusiastic", "vibrant", "lively", "intense", "powerful", "vigorous", "adrenaline", "energy"]),
    ("calm", ["relaxing", "calming", "soothing", "calm", "peaceful", "meditative", "mellow", "chill", "easygoing", "gentle", "relaxed", "tranquil", "serene"]),
    ("melancholic", ["sad", "melancholic", "melancholy", "sentimental", "nostalgic", "poignant", "sorrowful", "mournful", "longing"]),
    ("joyful", ["happy", "cheerful", "joyful", "fun", "festive", "positive", "uplifting", "happy mood", "celebratory", "feel good"]),
    ("tense", ["suspenseful", "suspense", "tense", "eerie", "ominous", "scary", "spooky", "mysterious", "anxious", "thrilling"]),
    ("romantic", ["romantic", "love song", "sensual", "romantic mood", "tender", "intimate"]),
    ("dark", ["dark", "haunting", "grim", "sinister", "menacing", "gloomy", "aggressive", "violent"]),
    ("triumphant", ["epic", "triumphant", "inspiring", "motivational", "heroic", "anthemic", "majestic", "victorious", "cinematic"]),
    ("playful", ["playful", "funny", "bouncy", "quirky", "silly", "whimsical", "cheeky", "humorous"]),
    ("dreamy", ["dreamy", "ethereal", "atmospheric", "hypnotic", "trippy", "psychedelic", "spacey", "floaty"]),
]
PRODUCTION = [
    ("live performance", ["live performance", "live recording", "live audience", "concert", "crowd cheering", "live", "audience"]),
    ("amateur recording", ["amateur recording", "home recording", "home video", "amateur", "tutorial"]),
    ("lo-fi recording", ["lo-fi", "lofi", "lo fi"]),
]
FIDELITY = [
    ("muffled recording", ["muffled", "muddy", "boomy", "muffled audio", "muffled sound"]),
    ("reverberant recording", ["reverberant", "reverb", "echo", "echoey", "echoing", "roomy", "wide reverb"]),
    ("noisy recording", ["noisy", "static", "hiss", "hissing", "white noise", "crackling", "crushed", "noise"]),
    ("low quality recording", ["low quality", "poor audio quality", "bad audio quality", "inferior audio quality", "low quality audio", "poor quality", "low quality recording", "average audio quality", "bad quality"]),
    ("clean recording", ["high quality", "good audio quality", "studio quality", "crisp", "clean", "polished", "high fidelity", "clear"]),
]
VOCAL_STYLE = [
    ("soft vocal", ["soft", "gentle", "tender", "mellow", "sweet"]),
    ("passionate vocal", ["passionate", "powerful", "emotional", "strong", "belting", "intense"]),
    ("flat vocal", ["flat"]),
    ("breathy vocal", ["breathy", "whispery", "whispered", "airy"]),
    ("operatic vocal", ["operatic", "opera", "soprano", "tenor"]),
    ("high-pitched vocal", ["high pitched", "high-pitched", "falsetto", "higher pitch", "high register"]),
    ("deep vocal", ["deep", "low pitched", "low-pitched", "baritone"]),
    ("harmonized vocals", ["harmonizing", "harmonising", "harmony", "harmonies", "backup", "background vocals", "backing vocals"]),
]
NO_VOCALS = ["instrumental", "instrumental music", "no voices", "no singer", "no voice", "no vocals", "no singers", "no vocal"]
VOICES = "vocals?|voices?|singers?|singing|vocalists?|vocalisation|rapper|crooner"

#: A voice as a whole word, and anywhere.
VOICE, VOICE_ANYWHERE = rf"\b({VOICES})\b", f"({VOICES})"


def words(*patterns: str) -> str:
    """A pattern that finds any of some as whole words."""
    return rf"\b(?:{'|'.join(patterns)})\b"
