"""The MQTT source against a broker of a few lines."""

import socket
import struct
import threading

from tidemill.operators.store import Store
from tidemill.streaming import mqtt as M
from tidemill.streaming.ingest import ingest

T0 = 1_700_000_000


class Broker(threading.Thread):
    """Sends its messages to each client until they are acknowledged."""

    def __init__(self, messages):
        super().__init__(daemon=True)
        self.messages = dict(enumerate(messages, 1))
        self.server = socket.create_server(("127.0.0.1", 0))
        self.port = self.server.getsockname()[1]
        self.asked = []

    def run(self):
        while True:
            client, _ = self.server.accept()
            threading.Thread(target=self.serve, args=(client,), daemon=True).start()

    def send(self, n):
        self.client.sendall(M.packet(M.PUBLISH, M.text("points") + struct.pack(">H", n) + self.messages[n].encode(), 2))

    def serve(self, client):
        link = M.Connection.__new__(M.Connection)
        link.socket, link.held = client, b""
        try:
            while (found := link._next(60)) is not None:
                head, body = found
                if head >> 4 == M.CONNECT:
                    client.sendall(M.packet(M.CONNACK, b"\x00\x00"))
                elif head >> 4 == M.SUBSCRIBE:
                    self.asked.append(body[2:])
                    self.client = client
                    client.sendall(M.packet(M.SUBACK, body[:2] + b"\x01"))
                    for n in sorted(self.messages):
                        self.send(n)
                elif head >> 4 == M.PUBACK:
                    self.messages.pop(struct.unpack(">H", body)[0], None)
        except OSError:
            pass


def test_packets_are_framed():
    assert M.packet(M.PUBLISH, b"x" * 200)[:3] == bytes([0x30, 0xC8, 1])
    assert M.text("é") == b"\x00\x02\xc3\xa9"


def test_messages_reach_the_store_and_are_acknowledged(spark, tmp_path):
    long = "\n".join(f"put m {T0 + k} {k} h=long" for k in range(200))
    broker = Broker([f"put m {T0} 1 h=a\nput m {T0 + 1} 2 h=a", f'put "m x" {T0} 1 h=a', f'{{"metric":"m","timestamp":{T0 + 2},"value":3,"tags":{{"h":"a"}}}}', long])
    broker.start()
    store = Store(spark, str(tmp_path / "s"))
    lines = M.mqtt_lines(spark, "127.0.0.1", broker.port, ["points"], wait="1")
    query = ingest(lines, store, str(tmp_path / "c"))
    try:
        for _ in range(60):
            query.awaitTermination(1)
            if store.exists("points") and store.points().count() == 203:
                break
        # What is in the store is acknowledged as soon as there is more.
        broker.messages[9] = f"put m {T0 + 5} 9 h=late"
        broker.send(9)
        for _ in range(60):
            query.awaitTermination(1)
            if store.points().count() == 204 and set(broker.messages) == {9}:
                break
    finally:
        query.stop()
    got = sorted((r.ts - T0, r.value) for r in store.points().where("tags['h'] = 'a'").collect())
    assert got == [(0, 1.0), (1, 2.0), (2, 3.0)] and store.points().count() == 204
    assert set(broker.messages) == {9} and broker.asked[0] == M.text("points") + b"\x01"
