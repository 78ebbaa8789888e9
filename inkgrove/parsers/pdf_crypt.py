"""Files that an empty password opens: RC4 and AES with keys of the standard handler."""

from __future__ import annotations

from hashlib import md5, sha256, sha384, sha512

from inkgrove.schema import ParseError

# The padding string of the PDF standard.
PAD = bytes.fromhex("28BF4E5E4E758A4164004E56FFFA01082E2E00B6D0683E802F0CA9FE6453697A")


def rc4(key: bytes, data: bytes) -> bytes:
    s, j = list(range(256)), 0
    for i in range(256):
        j = (j + s[i] + key[i % len(key)]) & 255
        s[i], s[j] = s[j], s[i]
    out, i, j = bytearray(), 0, 0
    for c in data:
        i = (i + 1) & 255
        j = (j + s[i]) & 255
        s[i], s[j] = s[j], s[i]
        out.append(c ^ s[(s[i] + s[j]) & 255])
    return bytes(out)


def _double(x: int) -> int:
    return (x << 1 ^ 0x11B) & 0xFF if x & 0x80 else x << 1


def _product(a: int, b: int) -> int:
    out = 0
    while b:
        if b & 1:
            out ^= a
        a, b = _double(a), b >> 1
    return out


def _boxes() -> tuple[list[int], list[int]]:
    """The substitution of AES by its rule: the inverse in the field, then an affine map."""
    log, power, x = [0] * 256, [0] * 256, 1
    for i in range(255):
        log[x], power[i] = i, x
        x ^= _double(x)
    box = [0] * 256
    for c in range(256):
        v = power[(255 - log[c]) % 255] if c else 0
        r = v
        for _ in range(4):
            v = (v << 1 | v >> 7) & 255
            r ^= v
        box[c] = r ^ 0x63
    back = [0] * 256
    for i, v in enumerate(box):
        back[v] = i
    return box, back


BOX, BACK = _boxes()
TIMES = {k: [_product(i, k) for i in range(256)] for k in (2, 3, 9, 11, 13, 14)}


class Aes:
    """Blocks of AES with a key of 16 or 32 bytes, and its chained mode."""

    def __init__(self, key: bytes):
        n = len(key) // 4
        words = [list(key[i : i + 4]) for i in range(0, len(key), 4)]
        rcon = 1
        for i in range(n, 4 * (n + 7)):
            w = list(words[-1])
            if i % n == 0:
                w = [BOX[x] for x in w[1:] + w[:1]]
                w[0] ^= rcon
                rcon = _double(rcon)
            elif n > 6 and i % n == 4:
                w = [BOX[x] for x in w]
            words.append([a ^ b for a, b in zip(words[i - n], w)])
        self.keys = [sum(words[i : i + 4], []) for i in range(0, len(words), 4)]

    @staticmethod
    def mixed(s: list[int], m: tuple[int, int, int, int]) -> list[int]:
        t = [TIMES.get(k) for k in m]
        out = []
        for c in range(0, 16, 4):
            for r in range(4):
                v = 0
                for k in range(4):
                    x = s[c + (r + k) % 4]
                    v ^= t[k][x] if t[k] else x
                out.append(v)
        return out

    def encrypt_block(self, block: bytes) -> bytes:
        s = [a ^ b for a, b in zip(block, self.keys[0])]
        for k in self.keys[1:]:
            s = [BOX[s[(i + 4 * (i % 4)) % 16]] for i in range(16)]
            if k is not self.keys[-1]:
                s = self.mixed(s, (2, 3, 1, 1))
            s = [a ^ b for a, b in zip(s, k)]
        return bytes(s)

    def decrypt_block(self, block: bytes) -> bytes:
        s = [a ^ b for a, b in zip(block, self.keys[-1])]
        for k in reversed(self.keys[:-1]):
            s = [BACK[s[(i - 4 * (i % 4)) % 16]] for i in range(16)]
            s = [a ^ b for a, b in zip(s, k)]
            if k is not self.keys[0]:
                s = self.mixed(s, (14, 11, 13, 9))
        return bytes(s)

    def decrypt(self, data: bytes, start: bytes, padded: bool = True) -> bytes:
        out, last = bytearray(), start
        for i in range(0, len(data) - 15, 16):
            block = data[i : i + 16]
            out += bytes(a ^ b for a, b in zip(self.decrypt_block(block), last))
            last = block
        if padded and out and 1 <= out[-1] <= 16:
            del out[-out[-1] :]
        return bytes(out)

    def encrypt(self, data: bytes, start: bytes) -> bytes:
        out, last = bytearray(), start
        for i in range(0, len(data), 16):
            last = self.encrypt_block(bytes(a ^ b for a, b in zip(data[i : i + 16], last)))
            out += last
        return bytes(out)


def hardened(password: bytes, salt: bytes, revision: int) -> bytes:
    """Hash of revisions 5 and 6."""
    k = sha256(password + salt).digest()
    if revision < 6:
        return k
    n = 0
    while True:
        e = Aes(k[:16]).encrypt((password + k) * 64, k[16:32])
        k = (sha256, sha384, sha512)[sum(e[:16]) % 3](e).digest()
        n += 1
        if n >= 64 and e[-1] <= n - 32:
            return k[:32]


class Decryptor:
    """Opens a file's strings and streams with the empty password, or says that it can't."""

    def __init__(self, info: dict, file_id: bytes):
        version, revision = info.get("V", 0), info.get("R", 0)
        if info.get("Filter") != "Standard":
            raise ParseError("encrypted_pdf")
        self.method, bits = "V2", info.get("Length", 40)
        if version in (4, 5):
            filters = info.get("CF", {})
            chosen = filters.get(info.get("StmF", "Identity"), {}) if isinstance(filters, dict) else {}
            self.method = str(chosen.get("CFM", "None"))
            bits = 256 if version == 5 else 128
        elif version not in (1, 2):
            raise ParseError("encrypted_pdf")
        user = info.get("U", b"")
        if version == 5:
            if hardened(b"", user[32:40], revision) != user[:32]:
                raise ParseError("encrypted_pdf")
            self.key = Aes(hardened(b"", user[40:48], revision)).decrypt(info.get("UE", b"")[:32], bytes(16), False)
            return
        size = 5 if revision == 2 else bits // 8
        key = md5(PAD + info.get("O", b"")[:32] + (info.get("P", 0) & 0xFFFFFFFF).to_bytes(4, "little") + file_id)
        if revision >= 4 and info.get("EncryptMetadata") is False:
            key.update(b"\xff" * 4)
        key = key.digest()
        if revision >= 3:
            for _ in range(50):
                key = md5(key[:size]).digest()
        self.key = key[:size]
        if revision == 2:
            good = rc4(self.key, PAD) == user[:32]
        else:
            check = rc4(self.key, md5(PAD + file_id).digest())
            for i in range(1, 20):
                check = rc4(bytes(b ^ i for b in self.key), check)
            good = check == user[:16]
        if not good:
            raise ParseError("encrypted_pdf")

    def open(self, data: bytes, number: int, generation: int) -> bytes:
        if self.method in ("None", "Identity"):
            return data
        if self.method == "AESV3":
            return Aes(self.key).decrypt(data[16:], data[:16])
        salt = number.to_bytes(3, "little") + generation.to_bytes(2, "little")
        aes = self.method == "AESV2"
        key = md5(self.key + salt + (b"sAlT" if aes else b"")).digest()[: min(16, len(self.key) + 5)]
        return Aes(key).decrypt(data[16:], data[:16]) if aes else rc4(key, data)
