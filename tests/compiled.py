import base64

#: Compiled from:
#: package a.db;
#: class Base { Base self; static int make(long n) { return (int) n; } }
#: class M extends Base implements Runnable {
#:   private Base other;
#:   public void run() { int x = Base.make(3L); switch (x) { case 1: case 900: run(); default: new M(); } }
#:   protected Base pick(Base[] all, String s) { return all[0]; }
#: }
M = base64.b64decode(
    "yv66vgAAAD0AHgoAAgADBwAEDAAFAAYBAAlhL2RiL0Jhc2UBAAY8aW5pdD4BAAMoKVYFAAAAAAAAAAMKAAIACgwACwAMAQAEbWFrZQEABChKKU"
    "kKAA4ADwcAEAwAEQAGAQAGYS9kYi9NAQADcnVuCgAOAAMHABQBABJqYXZhL2xhbmcvUnVubmFibGUBAAVvdGhlcgEAC0xhL2RiL0Jhc2U7AQAE"
    "Q29kZQEAD0xpbmVOdW1iZXJUYWJsZQEADVN0YWNrTWFwVGFibGUBAARwaWNrAQArKFtMYS9kYi9CYXNlO0xqYXZhL2xhbmcvU3RyaW5nOylMYS"
    "9kYi9CYXNlOwEAClNvdXJjZUZpbGUBAAZNLmphdmEAIAAOAAIAAQATAAEAAgAVABYAAAADAAAABQAGAAEAFwAAAB0AAQABAAAABSq3AAGxAAAA"
    "AQAYAAAABgABAAAAAwABABEABgABABcAAABWAAIAAgAAADEUAAe4AAk8G6sAAAAAAAAgAAAAAgAAAAEAAAAcAAADhAAAABwqtgANuwAOWbcAEl"
    "exAAAAAgAYAAAABgABAAAABQAZAAAABwAC/AAkAQMABAAaABsAAQAXAAAAHAACAAMAAAAEKwMysAAAAAEAGAAAAAYAAQAAAAYAAQAcAAAAAgAd"
)
BASE = base64.b64decode(
    "yv66vgAAAD0AEQoAAgADBwAEDAAFAAYBABBqYXZhL2xhbmcvT2JqZWN0AQAGPGluaXQ+AQADKClWBwAIAQAJYS9kYi9CYXNlAQAEc2VsZgEAC0"
    "xhL2RiL0Jhc2U7AQAEQ29kZQEAD0xpbmVOdW1iZXJUYWJsZQEABG1ha2UBAAQoSilJAQAKU291cmNlRmlsZQEABk0uamF2YQAgAAcAAgAAAAEA"
    "AAAJAAoAAAACAAAABQAGAAEACwAAAB0AAQABAAAABSq3AAGxAAAAAQAMAAAABgABAAAAAgAIAA0ADgABAAsAAAAbAAIAAgAAAAMeiKwAAAABAA"
    "wAAAAGAAEAAAACAAEADwAAAAIAEA=="
)


def renamed(name: bytes) -> bytes:
    """M under another name of six letters."""
    return M.replace(b"a/db/M", name)
